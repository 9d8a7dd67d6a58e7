import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from linkloom.llm import packing as P

SCHEMA = "doc_id long, text string, length string, rank string"


def check(docs, out):
    """Every id in one piece, sequences gapless; the padded share."""
    reference = Tokenizer.from_file(P.vocabulary())
    texts = defaultdict(list)
    for row in docs:
        texts[row[0]].append([*reference.encode(row[1] or "", add_special_tokens=False).ids, 2])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, rows in by_doc.items():
        expected = []
        for ids in texts[doc_id]:
            for at in range(0, len(ids), P.SEQUENCE):
                cut = ids[at : at + P.SEQUENCE]
                expected.append((at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()), len(ids)))
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == sorted(expected)
    held = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= P.SEQUENCE
        held += at
    return 1 - held / (P.SEQUENCE * len(by_sequence))


def test_round_trip_with_odd_rows(spark, folder_of, rng, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 30)
    words = "Ein the déjà-vu 12,5% foo_bar's ΣΑΣ é \x1c wide　space <|endoftext|> 😀!! \tTab".split(" ")
    docs = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choice(words) for _ in range(rng.randrange(0, 700))), "x", "y") for i in range(160)]
    docs += [(200, None, "x", "y"), (201, "", "x", "y"), (202, "long words " * 9000, "x", "y"), (203, "a" * 30000, None, None), docs[3], docs[3]]
    docs += [(300 + i, "same text for many rows", "x", "y") for i in range(120)]
    out = P.op6_sequence_packing(spark, folder_of("documents", docs, SCHEMA)).collect()
    assert check(docs, out) < 0.08


def test_tables_without_rows(spark, folder_of):
    assert P.op6_sequence_packing(spark, folder_of("documents", [], SCHEMA, 1)).count() == 0


def test_patterns_hold_each_length_as_often_as_it_occurs():
    generator = random.Random(3)
    for _ in range(40):
        histogram = {generator.randrange(1, 65): generator.randrange(1, 50) for _ in range(generator.randrange(1, 30))}
        patterns = P.shortest_pack_first(histogram, 64)
        found = defaultdict(int)
        for count, content in patterns:
            assert sum(n * t for n, t in content) <= 64
            for length, times in content:
                found[length] += count * times
        assert dict(found) == histogram and len(patterns) <= 2 * len(histogram) + 2


def test_ids_of_every_letter_beside_punctuation():
    """Every code point that may end a word, before and after each kind of punctuation, as the tokenizer has it."""
    import sys
    import unicodedata

    reference, encoder = Tokenizer.from_file(P.vocabulary()), P.Encoder(P.vocabulary())
    # Every assigned code point, and each 64th of the others.
    letters = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (c % 64 == 0 or unicodedata.category(chr(c)) not in ("Cn", "Co"))]
    marks = ".,!(-\"'_~"
    generator = random.Random(4)
    texts = []
    for at in range(0, len(letters), 512):
        some = letters[at : at + 512]
        texts.append(" ".join(f"{c}{generator.choice(marks)} x{c}{generator.choice(marks)}{generator.choice(marks)} {generator.choice(marks)}{c} a{c}b" for c in some))
    # All kinds of punctuation beside every letter that changes when it is normalised.
    odd = [c for c in letters if c.isalnum() and not c.isascii() and reference.normalizer.normalize_str(c) != c]
    texts += [" ".join(f"{c}{m} {c}{m}{c} {m}{c}" for m in P.PUNCTUATION + "'") for c in odd]
    for text, found in zip(texts, encoder.encode(texts), strict=True):
        expected = np.array([*reference.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert found == expected, text[:200]


def test_words_that_are_forgotten_get_the_same_ids(monkeypatch):
    texts = [" ".join(f"wort{i % 97}, x{i}." for i in range(at, at + 300)) for at in range(0, 3000, 150)]
    expected = list(P.Encoder(P.vocabulary()).encode(texts))
    monkeypatch.setattr(P, "REMEMBERED_BYTES", 20_000)
    encoder = P.Encoder(P.vocabulary())
    assert [ids for text in texts for ids in encoder.encode([text])] == expected
    # Two halves, each with what one call brought besides; all words together are over 6,000.
    assert len(encoder.known) + len(encoder.older) < 1200 < 6000 < len({w for t in texts for w in t.split()}) * 2

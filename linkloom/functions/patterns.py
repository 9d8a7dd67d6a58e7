"""Regular expressions used by the extraction jobs.

Every pattern here is written for ``java.util.regex`` and runs in linear time on
hostile input: repeated groups are possessive or bounded, and a scan may only
start where a run starts.
"""

# The quoted-link grammar. Group 1 is the text between the quotes.
QUOTED_LINK = (
    r"""(?:"|')("""
    r"""(?:(?:[a-zA-Z]{1,10}://|//)[^"'/]{1,}\.[a-zA-Z]{2,}[^"']{0,})"""
    r"""|(?:(?:/|\.\./|\./)[^"'><,;| *()(%%$^/\\\[\]][^"'><,;|()]{1,})"""
    r"""|(?:(?=[a-zA-Z0-9_\-/]+?/[a-zA-Z0-9_\-/])[a-zA-Z0-9_\-/]++\.(?:[a-zA-Z]{1,4}|action)(?:[\?|#][^"|']{0,}|))"""
    r"""|(?:(?=[a-zA-Z0-9_\-/]+?/[a-zA-Z0-9_\-/]{3})[a-zA-Z0-9_\-/]++(?:[\?|#][^"|']{0,}|))"""
    r"""|(?:[a-zA-Z0-9_\-]++\.(?:php|asp|aspx|jsp|json|action|html|js|txt|xml)(?:[\?|#][^"|']{0,}|))"""
    r""")(?:"|')"""
)

# Storage-bucket host and path forms.
BUCKET = (
    r"(?:\G|(?<![a-zA-Z0-9.-]))(?=[a-zA-Z0-9-]*+\.)(?=[a-zA-Z0-9.-]+\.[sS]3[.-])(?:"
    r"[a-zA-Z0-9.-]+(?i:\.s3\.amazonaws\.com)"
    r"|[a-zA-Z0-9.-]+(?i:\.s3-[a-z0-9-]\.amazonaws\.com)"
    r"|[a-zA-Z0-9.-]+(?i:\.s3-website[.-](?:eu|ap|us|ca|sa|cn)))"
    r"|//(?i:s3\.amazonaws\.com/[a-z0-9._-]+)"
    r"|//(?i:s3-[a-z0-9-]+\.amazonaws\.com/[a-z0-9._-]+)"
)

# A dotted run of host characters; a subdomain match never leaves such a run.
HOST_RUN = r"(?<![a-zA-Z0-9_-])[a-zA-Z0-9_-]++\.[a-zA-Z0-9_.-]++"
# Fixed value: up to 127 DNS labels, to be followed by a quoted domain.
DNS_LABELS = r"(?i)(?:(?:[a-z0-9]|[_a-z0-9][_a-z0-9-]{0,61}[a-z0-9])[.]){1,127}"

# Extensions that are never reported as links nor fetched.
STATIC_ASSET = (
    r"(?i)\.(?:png|apng|bmp|gif|ico|cur|jpg|jpeg|jfif|pjp|pjpeg|svg|tif|tiff|webp|xbm|3gp|aac|flac|mpg|mpeg"
    r"|mp3|mp4|m4a|m4v|m4p|oga|ogg|ogv|mov|wav|webm|eot|woff|woff2|ttf|otf|css)(?:\?|#|\z)"
)
# Extensions that make a link a script asset (case-sensitive).
SCRIPT_TAG_EXTENSIONS = [".js", ".xml", ".json"]
SCANNED_EXTENSIONS = [".js", ".xml", ".json", ".map"]

# Quoted text that is no link.
MIME_TOKEN = r"[a-zA-Z][a-zA-Z0-9.+-]*/[a-zA-Z0-9.+-]+"
DATE_TOKEN = r"\d{1,2}/\d{1,2}/\d{2,4}"

# Fixed value: everything up to the last "allow:"/"disallow:" of a robots line; (?d) keeps \r inside the line.
ROBOTS_PREFIX = r"(?i)(?d).*llow:\s*"
# Prefixes left over from percent-encoding in scraped host names.
HOST_RESIDUE = r"^(?:20|25|2b|2f|3d|3a|40)+"
# A host name that cleaning would not change.
CLEAN_HOST = r"^(?!20|25|2b|2f|3d|3a|40)[a-z0-9_][a-z0-9_.-]*+(?<!-)\z"

# The white space trimmed around tokens, as a character class body.
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# One look at a token for all of it: nothing but white space, or a MIME type or date between white space.
NOISE = rf"^[{SPACE}]*+(?:{MIME_TOKEN}|{DATE_TOKEN})?[{SPACE}]*+\z"

# Elements whose content is text, not markup.
RAW_TEXT_ELEMENTS = "script style title textarea noscript xmp iframe noembed noframes".split()
LINK_ELEMENTS = "a link form input base".split()
_TAG_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"?|'[^']*+'?|[^\s>"'][^\s>]*+)?)*+>?"""
# One pass over a document: comments and raw text are consumed, group 1 keeps start tags only.
# The empty group 3 takes part only for raw-text elements, so \3 tells them apart.
TAGS = (
    r"(?is)(?=<)(?:<!--.*?(?:-->|\z)|(<(?:(" + "|".join(RAW_TEXT_ELEMENTS) + r")()|" + "|".join(LINK_ELEMENTS)
    + r")(?=[\s/>])" + _TAG_REST + r")(?:\3.*?(?:</\2(?=[\s/>])|\z))?+)"
)

# Resource types never loaded, and those whose requests are findings.
BLOCKED_RESOURCES = ["Image", "Stylesheet", "Media", "Font"]
REQUEST_RESOURCES = ["XHR", "Fetch"]

# Where sitemaps are looked for.
SITEMAP_PATHS = [
    "/sitemap.xml",
    "/sitemap_news.xml",
    "/sitemap_index.xml",
    "/sitemap-index.xml",
    "/sitemapindex.xml",
    "/sitemap-news.xml",
    "/post-sitemap.xml",
    "/page-sitemap.xml",
    "/portfolio-sitemap.xml",
    "/home_slider-sitemap.xml",
    "/category-sitemap.xml",
    "/author-sitemap.xml",
]
# Fixed value: where robots files are.
ROBOTS_PATH = "/robots.txt"

# The size, in bytes, under which a page may be worth rendering, and how many are rendered.
MAX_RENDER_BYTES = 60 * 1024
RENDER_BUDGET = 6

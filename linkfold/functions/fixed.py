"""Fixed values of the code format. Codes made elsewhere decode here only with exactly these values, in this order."""

#: Digits of the 66-character alphabet: the unreserved characters of RFC 3986.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"

#: Dictionary tokens; a token's number is its place, its byte 0x80 + number.
ATLAS = [
    "https://store.steampowered.com/app/",
    "https://www.linkedin.com/posts/",
    "https://www.youtube.com/watch?v=",
    "https://x.com/rustlang/status/",
    "https://doc.rust-lang.org/book/",
    "https://en.wikipedia.org/wiki/",
    "https://api.github.com/repos/",
    "https://www.instagram.com/p/",
    "https://github.com/rust-lang/",
    "https://www.amazon.com/dp/",
    "https://www.reddit.com/r/",
    "https://crates.io/crates/",
    "https://twitter.com/",
    "https://facebook.com/",
    "https://youtube.com/",
    "https://github.com/",
    "https://medium.com/",
    "https://tiktok.com/",
    "https://google.com/",
    "https://apple.com/",
    "https://wa.me/",
    "https://x.com/",
    "https://shop.",
    "https://portal.",
    "https://api.",
    "https://dev.",
    "https://media.",
    "https://blog.",
    "https://m.",
    "https://mail.",
    "https://www.",
    "https://",
    "http://www.",
    "http://",
    "/shop/products/deals/",
    "/shop/products/",
    "/wiki/articles/",
    "/explore/tags/",
    "/feed/trending/",
    "/comments/thread/",
    "/user/profile/",
    "/questions/tagged/",
    "/questions/",
    "/search?q=",
    "/track/event/",
    "/blob/master/",
    "/blob/main/",
    "/comments/",
    "/compiler/",
    "/status/",
    "/issues/",
    "/watch?v=",
    "/pull/",
    "/posts/",
    "/api/v1/",
    "/api/v2/",
    "?state=open&sort=created&direction=desc",
    "?utm_source=",
    "?utm_medium=",
    "?utm_campaign=",
    "?utm_content=",
    "?utm_term=",
    "?fbclid=",
    "?gclid=",
    "?igshid=",
    "?ref=",
    "&utm_source=",
    "&utm_medium=",
    "&utm_campaign=",
    "&utm_content=",
    "&utm_term=",
    "&fbclid=",
    "&gclid=",
    "&igshid=",
    "&session_id=",
    "&timestamp=",
    "&msclkid=",
    "&twclid=",
    "&ttclid=",
    "&source=",
    "&ref=",
    "&amount=",
    "&label=",
    "&subject=",
    "&dn=",
    ".com/",
    ".org/",
    ".net/",
    ".ru/",
    ".io/",
    "distributed",
    "concurrency",
    "algorithms",
    "compression",
    "optimization",
    "performance",
    "benchmark",
    "analysis",
    "database",
    "compiler",
    "systems",
    "succinct",
    "entropy",
    "hashing",
    "manifest",
    "cluster",
    "vector",
    "payload",
    "token",
    "lexer",
    "shard",
    "graph",
    "rust",
    "magnet:?xt=urn:btih:",
    "ipfs://bafybeic",
    "ipfs://",
    "ipns://",
    "mailto:",
    "bitcoin:",
    "ethereum:",
    "file:///",
    "ftp://",
    "ssh://",
    "wss://",
    "ws://",
    "urn:",
]

#: Tokens of the byte transcoder with their numbers; the first that fits is taken.
TRANSCODER = [
    ("https://www.", 0x01),
    ("https://shop.", 0x05),
    ("https://portal.", 0x06),
    ("https://api.", 0x07),
    ("https://dev.", 0x08),
    ("https://media.", 0x09),
    ("https://blog.", 0x0A),
    ("https://m.", 0x0B),
    ("https://mail.", 0x0C),
    ("https://", 0x02),
    ("http://www.", 0x03),
    ("http://", 0x04),
    ("?utm_source=", 0x10),
    ("&utm_medium=", 0x11),
    ("&utm_campaign=", 0x12),
    ("&utm_content=", 0x13),
    ("&utm_term=", 0x14),
    ("&gclid=", 0x15),
    ("&fbclid=", 0x16),
    ("&session_id=", 0x17),
    ("&timestamp=", 0x18),
    (".com/", 0x20),
    (".org/", 0x21),
    (".net/", 0x22),
    (".io/", 0x23),
    ("/user/profile/", 0x30),
    ("/shop/products/deals/", 0x31),
    ("/shop/products/", 0x32),
    ("/wiki/articles/", 0x33),
    ("/explore/tags/", 0x34),
    ("/feed/trending/", 0x35),
    ("/blob/main/", 0x36),
    ("/track/event/", 0x37),
    ("/questions/", 0x38),
    ("/search?q=", 0x39),
]

#: Symbols of the store's payloads; the first that fits is taken, its byte pair is FF and its place.
SYMBOLS = [
    "https://www.",
    "https://",
    "http://www.",
    "http://",
    "github.com/",
    "amazon.com/dp/",
    "store.steampowered.com/",
    "instagram.com/p/",
    "reddit.com/r/",
    "linkedin.com/posts/",
    "wikipedia.org/wiki/",
    "youtube.com/watch?v=",
    "crates.io/crates/",
    "doc.rust-lang.org/",
    "?utm_source=",
    "&utm_medium=",
    "&utm_campaign=",
    "&gclid=",
    "&fbclid=",
    "?ref=",
    "?igshid=",
    "/status/",
    "/comments/",
    "/compiler/",
    "/blob/master/",
    ".html",
    ".org",
    ".com",
    ".io",
    "ipfs://",
    "magnet:?xt=urn:btih:",
    "mailto:",
    "bitcoin:",
    "0IL6S",
    "0CbWV",
    "0BXdx",
    "0ARjp",
    "0Acons",
    "0ODif",
    "0Cbt0",
    "0HHnY",
    "0BFVy",
    "0GLds",
    "0CBIK",
    "0ymfp",
    "0irBQ",
]

#: Parametric links by number; {i} is the i-th slot.
TEMPLATES = {
    1: "https://www.amazon.com/dp/{0}?ref={1}&utm_source={2}&utm_medium={3}&utm_campaign={4}&utm_content={5}&gclid={6}",
    2: "https://store.steampowered.com/app/{0}/{1}/?utm_source={2}&utm_medium={3}&utm_campaign={4}&fbclid={5}",
    3: "https://www.instagram.com/p/{0}/?igshid={1}",
    4: "https://www.reddit.com/r/{0}/comments/{1}/{2}/",
    5: "https://www.linkedin.com/posts/{0}",
    6: "https://api.github.com/repos/{0}/{1}/issues?state={2}&sort={3}&direction={4}",
    7: "https://github.com/{0}/{1}/blob/{2}/{3}",
    8: "https://github.com/{0}/{1}/pull/{2}",
    9: "mailto:{0}?subject={1}",
    10: "bitcoin:{0}?amount={1}&label={2}",
    11: "magnet:?xt=urn:btih:{0}&dn={1}",
    12: "https://x.com/{0}/status/{1}",
    13: "https://www.youtube.com/watch?v={0}",
}

#: Counts of the generic byte profile: by characters, then for bytes from 0x80, then for all others.
GENERIC_COUNTS = (("abcdefghijklmnopqrstuvwxyz", 10), ("0123456789", 8), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 6), ("-._~/:?&=%#+@", 15))
GENERIC_HIGH, GENERIC_OTHER = 12, 1
#: Sum of the frequencies of a table.
SCALE = 4096
#: Lower bound of the coder's state.
RANS_LOW = 1 << 16

#: Initial values of BLAKE3 (those of SHA-256), its message permutation and flags.
BLAKE3_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
BLAKE3_PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
BLAKE3_START, BLAKE3_END, BLAKE3_PARENT, BLAKE3_ROOT = 1, 2, 4, 8

#: Header names that hold links, by priority; schemes that need no prefix.
LINK_HEADERS = (("url", "urls", "link", "uri", "website"), ("domain", "domains", "host"))
KNOWN_SCHEMES = ("http://", "https://", "ipfs://", "magnet:", "mailto:", "bitcoin:")
#: Bytes of a stored record's frame, of a delta header and of an anchor header.
FRAME_BYTES, DELTA_HEADER, ANCHOR_HEADER = 34, 38, 2
#: Least similarity to join an anchor, and most anchors of a shard.
ANCHOR_SIMILARITY, ANCHORS = 0.35, 255
#: First bytes of a container, and its version.
MAGIC, VERSION = b"URLS", 1

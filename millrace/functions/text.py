"""Column builders for text, with the semantics of the engine's rules.

Word boundaries and word characters are ASCII; white space is Unicode's; lengths are UTF-16 units
where a rule counts characters (equal to code points in text without supplementary characters).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes.
SPACES = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: An ASCII word boundary, as Java's own knows Unicode letters.
BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: Character classes of scripts that are written without spaces.
CJK = r"\u4E00-\u9FFF\u3400-\u4DBF\uF900-\uFAFF\u3040-\u309F\u30A0-\u30FF\uAC00-\uD7AF"
CJK_WIDE = r"\u4E00-\u9FFF\u3400-\u4DBF\u3000-\u303F\u3040-\u309F\u30A0-\u30FF\uAC00-\uD7AF\uFF00-\uFFEF"


def ascii_bounded(pattern: str) -> str:
    """A pattern whose ``\\b`` is an ASCII word boundary."""
    return pattern.replace(r"\b", BOUNDARY)


def js_trim(c: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(c, f"^{SPACES}+|{SPACES}+$", "")


def utf16_length(c: Column) -> Column:
    """Number of UTF-16 code units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("bigint")


def filled(c: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(c, F.lit(""))


def half_up(c: Column) -> Column:
    """Rounding to whole numbers with halves towards plus infinity."""
    return F.floor(c + 0.5)


def matches(c: Column, pattern: str) -> Column:
    """How often a pattern occurs; ``\\b`` is ASCII."""
    return F.regexp_count(c, F.lit(ascii_bounded(pattern)))


def found(c: Column, pattern: str) -> Column:
    """Whether a pattern occurs; ``\\b`` is ASCII."""
    return F.rlike(c, F.lit(ascii_bounded(pattern)))


def whitespace_tokens(c: Column) -> Column:
    """Tokens between white space."""
    return F.array_remove(F.split(c, SPACES + "+"), "")


def simple_tokens(c: Column) -> Column:
    """Estimated tokens: a quarter of the characters, rounded up."""
    return F.ceil(F.coalesce(utf16_length(c), F.lit(0)) / 4).cast("bigint")


def cjk_tokens(c: Column) -> Column:
    """Estimated tokens: CJK characters whole, a quarter of the others."""
    text = F.coalesce(c, F.lit(""))
    n = F.regexp_count(text, F.lit(f"[{CJK_WIDE}]"))
    return F.ceil(n + (utf16_length(text) - n) / 4).cast("bigint")


def has_cjk(c: Column) -> Column:
    """Whether text holds Han, Hiragana, Katakana or Hangul."""
    return F.rlike(c, F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"))


def script(c: Column) -> Column:
    """cjk, latin or arabic if text holds that script alone, else mixed."""
    cjk, latin, arabic = (F.rlike(c, F.lit(x)) for x in (f"[{CJK}]", r"[A-Za-z\u00C0-\u024F]", r"[\u0600-\u06FF]"))
    return F.when(cjk & ~latin & ~arabic, "cjk").when(latin & ~cjk & ~arabic, "latin").when(arabic & ~cjk & ~latin, "arabic").otherwise("mixed")


#: What code, mathematics, tables and images look like to the two rules below.
DIFFICULT_CODE, DIFFICULT_MATHS = r"```|function\s|class\s|def\s", r"\$[^$]+\$|\\frac|\\sum|\\int"
CODE, MATHS = r"```|`[^`]+`|function\s|class\s|def\s|import\s|require\(", r"\$[^$]+\$|\\frac|\\sum|\\int|\\sqrt"
TABLE_ROW, TABLE_RULE, IMAGE = r"\|.*\|.*\|", r"\|[-:\s]+\|", r"!\[.*\]\(.*\)|<img|data:image/"


def difficulty(c: Column) -> Column:
    """easy, medium or hard, from length, sentences, word length, code and mathematics."""
    length = utf16_length(c)
    average = length / F.greatest(F.lit(1), F.size(F.split(c, SPACES + "+")))
    one = lambda x, n=1: F.when(x, n).otherwise(0)
    score = (
        F.when(length > 2000, 2).when(length > 500, 1).otherwise(0)
        + one(F.regexp_count(c, F.lit(r"[.!?]+")) > 10)
        + one(average > 6)
        + one(F.rlike(c, F.lit(DIFFICULT_CODE)))
        + one(F.rlike(c, F.lit(DIFFICULT_MATHS)), 2)
    )
    return F.when(score >= 4, "hard").when(score >= 2, "medium").otherwise("easy")


#: The verbs of each level, from the highest.
BLOOM = (
    ("create", "create|design|build|develop|compose|generate|construct"),
    ("evaluate", "evaluate|judge|assess|critique|justify|defend|argue"),
    ("analyze", "analyze|compare|contrast|examine|investigate|differentiate"),
    ("apply", "apply|use|implement|demonstrate|solve|calculate"),
    ("understand", "understand|explain|describe|summarize|interpret|classify"),
)


def bloom_level(c: Column) -> Column:
    """The highest level of Bloom's taxonomy whose verbs occur."""
    low, out = F.lower(c), None
    for level, verbs in BLOOM:
        hit = found(low, rf"\b(?:{verbs})\b")
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out.otherwise("remember")


#: Long words that are no topic.
TOPIC_STOP = "which there their about would could should between through during before after above below other where while these those being".split()
TOPIC_SPLIT = r"[^a-z\u4E00-\u9FFF\u3040-\u309F\u30A0-\u30FF\uAC00-\uD7AF]+"


def topic_words(c: Column) -> Column:
    """Words that may be a text's topic, in order."""
    cjk = r"[\u4E00-\u9FFF\u3040-\u309F\u30A0-\u30FF\uAC00-\uD7AF]"
    stop = F.array(*map(F.lit, TOPIC_STOP))
    return F.filter(
        F.split(F.lower(c), TOPIC_SPLIT),
        lambda w: (w != "") & F.when(F.rlike(w, F.lit(cjk)), F.length(w) >= 2).otherwise(F.length(w) > 4) & ~F.array_contains(stop, w),
    )


def chunk_traits(c: Column) -> Column:
    """Struct of what a model has to cope with: code, mathematics, tables, images, language, complexity."""
    length = utf16_length(c)
    code = F.rlike(c, F.lit(CODE))
    maths = F.rlike(c, F.lit(MATHS))
    table = F.rlike(c, F.lit(TABLE_ROW)) & F.rlike(c, F.lit(TABLE_RULE))
    image = F.rlike(c, F.lit(IMAGE))
    language = F.when(F.rlike(c, F.lit(r"[\u4E00-\u9FFF]")), "zh").when(F.rlike(c, F.lit(r"[\u3040-\u309F\u30A0-\u30FF]")), "ja").when(F.rlike(c, F.lit(r"[\uAC00-\uD7AF]")), "ko").otherwise("en")
    multi = F.rlike(c, F.lit(r"[\u4E00-\u9FFF\u3040-\u309F\u30A0-\u30FF\uAC00-\uD7AF]")) & F.rlike(c, F.lit("[a-zA-Z]"))
    complexity = F.when((length > 5000) | maths | code, "hard").when((length > 2000) | table, "medium").otherwise("easy")
    return F.struct(length.alias("length"), code.alias("has_code"), maths.alias("has_math"), table.alias("has_table"), image.alias("has_image"), language.alias("language"), multi.alias("is_multilingual"), complexity.alias("complexity"))


def csv_escape(c: Column) -> Column:
    """A CSV cell: doubled quotes, a guard against formulas, quotes where needed."""
    doubled = F.replace(c, F.lit('"'), F.lit('""'))
    guarded = F.when(F.rlike(doubled, F.lit(r"^[=+\-@\t\r]")), F.concat(F.lit("'"), doubled)).otherwise(doubled)
    return F.when(F.rlike(guarded, F.lit('[,"\\n\\r]')), F.concat(F.lit('"'), guarded, F.lit('"'))).otherwise(guarded)


def tsv_escape(c: Column) -> Column:
    """A TSV cell: as CSV, with tabs in the place of commas."""
    guarded = F.when(F.rlike(c, F.lit(r"^[=+\-@]")), F.concat(F.lit("'"), c)).otherwise(c)
    quoted = F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.rlike(guarded, F.lit('[\\t"\\n\\r]')), quoted).otherwise(guarded)


def html_escape(c: Column) -> Column:
    """Text for HTML."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def decode_entities(c: Column) -> Column:
    """Named and decimal entities of ASCII as characters, the ampersand last."""
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " ")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    numbers = F.array_distinct(F.regexp_extract_all(c, F.lit(r"&#(\d{1,7});"), F.lit(1)))
    valid = F.filter(numbers, lambda n: (n.cast("int") > 0) & (n.cast("int") < 0x110000) & ~n.cast("int").between(0xD800, 0xDFFF))
    utf32 = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0")), "UTF-32")
    decoded = F.aggregate(valid, c, lambda t, n: F.replace(t, F.concat(F.lit("&#"), n, F.lit(";")), utf32(n)))
    return F.replace(F.when(F.contains(c, F.lit("&#")), decoded).otherwise(c), F.lit("&amp;"), F.lit("&"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def size_label(n: Column) -> Column:
    """Size category of a dataset."""
    return F.when(n < 1000, "n<1K").when(n < 10_000, "1K<n<10K").when(n < 100_000, "10K<n<100K").otherwise("100K<n<1M")


def duration_label(ms: Column) -> Column:
    """Milliseconds as 1h 2m 3s."""
    s = F.floor(ms / 1000).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))


def timestamp_label(seconds: Column) -> Column:
    """Seconds as HH:MM:SS."""
    s = F.floor(seconds).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def redact_log(c: Column) -> Column:
    """A log line without mail addresses, card, social security and phone numbers, or keys."""
    for pattern, mark in (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
        (r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "[CARD]"),
        (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
        (r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b", "[PHONE]"),
        (r"\b(?:sk|pk|api)[-_][A-Za-z0-9]{16,}\b", "[KEY]"),
    ):
        c = F.regexp_replace(c, ascii_bounded(pattern), mark)
    return c


def hash32(c: Column) -> Column:
    """Signed 32-bit hash (times 31 plus the UTF-16 unit) of a text."""
    add = lambda h, unit: F.pmod(h * 31 + unit, F.lit(1 << 32))

    def step(h: Column, ch: Column) -> Column:
        point = F.ascii(ch).cast("bigint")
        high = F.lit(0xD800) + F.shiftright(point - 0x10000, 10)
        low = F.lit(0xDC00) + (point - 0x10000).bitwiseAND(F.lit(0x3FF))
        return F.when(point < 0x10000, add(h, point)).otherwise(add(add(h, high), low))

    value = F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0).cast("bigint"), step)
    return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value)


def size_text(size: Column) -> Column:
    """A number of bytes in the largest unit up to GB, with two decimals at most."""
    unit = F.when(size == 0, 0).otherwise(F.floor(F.log2(size.cast("double")) / 10 + 1e-12)).cast("int")
    value = F.round(size / F.pow(F.lit(1024.0), unit), 2)
    shown = F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")
    label = F.when(unit == 0, F.when(value == 1, "byte").otherwise("bytes")).when(unit == 1, "KB").when(unit == 2, "MB").otherwise("GB")
    return F.concat_ws(" ", F.when(size == 0, "0").otherwise(shown), label)


#: Languages that are written from right to left.
RTL = ("ar", "arc", "dv", "fa", "ha", "he", "khw", "ks", "ku", "ps", "sd", "ug", "ur", "yi")


def right_to_left(locale: Column) -> Column:
    """Whether a locale's language is written from right to left."""
    return F.split(F.lower(F.trim(locale)), "-")[0].isin(*RTL)


#: What begins a prompt's request to think first, and the headings that end it.
THINKING = (
    "Before producing", "internally verify", "internal verification", "complete internal verification", "内部校验", "内部校驗", "comprobación interna",
    "vérification interne", "interne Überprüfung", "verifica interna", "verificação interna", "内部検証", "남부 검증",
)
OUTPUT_HEADINGS = ("OUTPUT FORMAT", "输出格式", "Formato de salida", "Format de sortie", "Ausgabeformat", "出力形式", "출력 형식")


def without_thinking(prompt: Column) -> Column:
    """A prompt without its first request to think, up to the heading of the output's format; unchanged without such a heading."""
    opening = rf"(?:^|\n)\s*(?:\d+\.\s*)?(?:{'|'.join(THINKING)})"
    closing = rf"\n\s*(?:{'|'.join(OUTPUT_HEADINGS)})"
    pattern = rf"(?isu)\A(.*?){opening}.*?(?={closing})"
    return F.regexp_replace(prompt, pattern, "$1\n")


def valid_url(url: Column) -> Column:
    """Whether an address is one of the web: a scheme, a host, and no blanks in these."""
    return F.rlike(F.trim(F.coalesce(url, F.lit(""))), F.lit(r"(?i)^https?:/*[^\s/?#\\<>^|%\[\]@:]+(?::\d{0,5})?(?:[/?#].*)?$"))


def fuzzy_score(query: str, target: str) -> int:
    """How well the letters of ``query`` are found in ``target``, in order; -1 if they aren't.

    A part of the target scores 1000 less the letters that it leaves out; otherwise runs of letters
    score 10, 20, 30 ... a letter and single letters 1, with 15 more where a word begins.
    """
    q, t = query.lower(), target.lower()
    if not q:
        return 0
    if q in t:
        return 1000 - (len(t) - len(q))
    score, run, at = 0, 0, -1
    last = -2
    for ch in q:
        at = t.find(ch, at + 1)
        if at < 0:
            return -1
        run = run + 1 if at == last + 1 else 0
        score += 10 * run if run else 1
        before = t[at - 1] if at else " "
        score += 15 * (before == " " or (before != before.upper() and ch == ch.upper()))
        last = at
    return score


def encrypted(c: Column, key: Column) -> Column:
    """A text under AES-GCM with a key of 16, 24 or 32 bytes, in Base64; the nonce is a new one each time."""
    return F.base64(F.aes_encrypt(c.cast("binary"), key, F.lit("GCM")))


def decrypted(c: Column, key: Column) -> Column:
    """The text of :func:`encrypted`, null where the key is wrong or the text was changed."""
    return F.try_aes_decrypt(F.unbase64(c), key, F.lit("GCM")).cast("string")

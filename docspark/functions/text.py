"""Column functions on text.  A null text counts as empty unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Unicode calls white space, and those of them that stay within a line.
WS = r"[ \t\n\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_WS = r"[ \x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
CONTROLS = r"[\x00-\x09\x0B\x0C\x0E-\x1F\x7F]"
#: Messages that are greetings.
GREETINGS = ["你好", "您好", "早上好", "下午好", "晚上好", "嗨", "hi", "hello", "hey", "嘿", "哈喽", "喂", "在吗", "在么", "在不在"]
#: What is known of file extensions when files are stored, parsed, and sniffed.
STORED_MIME = {
    "pdf": "application/pdf", "md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png",
}
PARSED_MIME = {
    "pdf": "application/pdf", "md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "html": "text/html", "htm": "text/html", "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "json": "application/json", "rtf": "application/rtf",
}
UNKNOWN_MIME = "application/octet-stream"
ROLES = ["system", "user", "assistant"]
#: Very frequent words of each language.
STOP_WORDS = {
    "en": "the of and to in is that for it was on are with as by this from be", "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine",
    "fr": "le la les de et des en un une du que est pour qui dans sur pas au", "es": "el la de que y en un los se del las por con para una su al es",
}
#: Letters and groups of letters that are frequent in each language and rare in the others, as patterns whose matches are counted.
PROFILES = {
    "en": "th|wh|sh|wa|ing|ed|ly", "de": "sch|ch|ei|ung|pf|tz|ü|ö|ä|ß",
    "fr": "eau|eux|ai|oi|qu|é|è|ê|ç|à|œ", "es": "ción|ll|rr|ñ|ó|í|á|ú|¿|¡",
}
#: A frequent word counts as much as so many groups of letters.
WORD_WEIGHT = 3


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def clean_text(c: Column | str) -> Column:
    """At most one blank line in a row, no control characters (tabs included), single spaces, stripped lines."""
    t = F.regexp_replace(_text(c), r"\n{3,}", "\n\n")
    t = F.regexp_replace(F.regexp_replace(t, CONTROLS, ""), " {2,}", " ")
    t = F.regexp_replace(t, r"\r\n|[\r\x{85}\x{2028}\x{2029}]", "\n")
    t = F.regexp_replace(t, f"(?m)^{LINE_WS}+|{LINE_WS}+$", "")
    return F.regexp_replace(t, r"\A\n+|\n+\z", "")


def words(c: Column | str) -> Column:
    return F.filter(F.split(_text(c), WS + "+"), lambda x: x != "")


def count_words(c: Column | str) -> Column:
    return F.size(words(c)).cast("bigint")


def count_chars(c: Column | str) -> Column:
    """Characters that are no white space."""
    return F.length(F.regexp_replace(_text(c), WS, "")).cast("bigint")


def raw_length(c: Column | str) -> Column:
    return F.length(_text(c)).cast("bigint")


def estimate_tokens(c: Column | str) -> Column:
    return F.greatest(count_words(c), F.floor(F.length(_text(c)) / 4).cast("bigint"))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def title_from_metadata(title: Column, text: Column | str, file_name: Column) -> Column:
    """The metadata's title, else the first line that is not empty and under 100 characters, else the file's stem."""
    lines = F.filter(F.transform(F.split(_text(text), "\n"), strip), lambda x: (x != "") & (F.length(x) < 100))
    stem = F.nullif(file_stem(file_name), F.lit(""))
    return F.coalesce(F.nullif(title, F.lit("")), F.get(lines, 0), stem, F.lit("Untitled Document"))


def title_from_lines(text: Column | str, file_name: Column) -> Column:
    """Of the first five lines the first of 3 to 100 characters that has a letter; else the file's stem."""
    lines = F.slice(F.split(strip(_text(text)), "\n"), 1, 5)
    good = F.filter(F.transform(lines, strip), lambda x: F.length(x).between(3, 100) & ~x.rlike(r"(?U)^[\d\W]+$"))
    return F.coalesce(F.get(good, 0), F.nullif(file_stem(file_name), F.lit("")), F.lit("Untitled Document"))


def chat_title(c: Column | str, limit: int = 30) -> Column:
    """A first message as a title: whole up to `limit` characters, else up to the last space within, and `...`."""
    t = strip(_text(c))
    head = F.substring(t, 1, limit + 1)
    at = F.length(head) - F.instr(F.reverse(head), " ")  # 0-based index of the last space
    short = F.when((F.instr(head, " ") > 0) & (at > 0), F.substring(head, F.lit(1), at)).otherwise(F.substring(t, 1, limit))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(short, F.lit("...")))


def is_greeting(c: Column | str) -> Column:
    """One of the fixed greetings, or under 8 bytes and beginning with one and a space."""
    t = F.lower(F.trim(_text(c)))
    begins = [F.startswith(t, F.lit(g + " ")) for g in GREETINGS]
    either = begins[0]
    for b in begins[1:]:
        either = either | b
    return t.isin(GREETINGS) | ((F.octet_length(t) < 8) & either)


def file_type(name: Column) -> Column:
    """What follows the last dot; the whole name if there is none."""
    return F.element_at(F.split(name, r"\."), -1)


def file_stem(name: Column) -> Column:
    return F.regexp_extract(F.element_at(F.split(F.coalesce(name, F.lit("")), "/"), -1), r"^(.+?)(\.[^.]*)?$", 1)


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^./](\.[^./]*)$", 1))


def mime_type(name: Column, known: dict[str, str] = STORED_MIME) -> Column:
    """By the extension; a name without a dot has none."""
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.substring(file_extension(name), 2, 99)), F.lit(UNKNOWN_MIME))


def truncate(c: Column | str, limit: int = 8192) -> Column:
    return F.substring(_text(c), 1, limit)


def format_bytes(n: Column) -> Column:
    """1536 is `1.5 KB`: two places at most; null counts as 0."""
    power = F.when(n > 0, F.least(F.floor(F.log(2.0, n.cast("double")) / 10), F.lit(3))).otherwise(0)
    value = F.round(n / F.pow(F.lit(1024.0), power), 2)
    said = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), r"0+$", ""), r"\.$", "")
    unit = F.element_at(F.array(*map(F.lit, ["Bytes", "KB", "MB", "GB"])), (power + 1).cast("int"))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, "0 Bytes").otherwise(F.concat(said, F.lit(" "), unit))


def format_seconds(s: Column) -> Column:
    """`12.3s`, `1m 2s`, `1h 3m`; null or 0 is `0s`."""
    whole = lambda x: F.floor(x).cast("bigint").cast("string")
    return (
        F.when(F.coalesce(s, F.lit(0.0)) == 0, "0s")
        .when(s < 60, F.format_string("%.1fs", s.cast("double")))
        .when(s < 3600, F.concat(whole(s / 60), F.lit("m "), F.round(s % 60).cast("bigint").cast("string"), F.lit("s")))
        .otherwise(F.concat(whole(s / 3600), F.lit("h "), whole((s % 3600) / 60), F.lit("m")))
    )


def number_display(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x.isNull(), "0").when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(F.format_string("%.2f", F.round(x, 2)))


def scope_key(prefix: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), *parts)


def preview(c: Column | str, limit: int = 200) -> Column:
    t = _text(c)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)


def fill_template(template: Column | str, question: Column, context: Column, marks: tuple[str, str] = ("{question}", "{context}")) -> Column:
    """The question is put in first, as it may not bring marks of its own into the context's place."""
    t = F.lit(template) if isinstance(template, str) else template
    return F.replace(F.replace(t, F.lit(marks[0]), question), F.lit(marks[1]), context)


def token_usage(prompt: Column, answer: Column) -> Column:
    one = lambda c: (count_words(c) * 1.3).cast("int")
    total = ((count_words(prompt) + count_words(answer)) * 1.3).cast("int")
    return F.struct(one(prompt).alias("prompt_tokens"), one(answer).alias("completion_tokens"), total.alias("total_tokens"))


def normalise_role(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.isin(ROLES), low).otherwise("user")


def guess_language(c: Column | str, limit: int = 1000, default: str = "en") -> Column:
    """The language whose frequent words and letters the first characters have most of; a tie or none gives the default."""
    low = F.lower(F.substring(_text(c), 1, limit))
    found = F.split(low, r"[^\p{L}]+")
    among = lambda known: F.size(F.filter(found, lambda w: w.isin(known.split())))
    hits = {k: WORD_WEIGHT * among(known) + F.regexp_count(low, F.lit(PROFILES[k])) for k, known in STOP_WORDS.items()}
    best = F.greatest(*hits.values())
    said = F.lit(default)
    for k in sorted(hits, reverse=True):
        if k != default:
            said = F.when((hits[k] == best) & (hits[k] > hits[default]), k).otherwise(said)
    return said

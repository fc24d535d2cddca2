"""Column functions over text: hashes, canonical text, tokens, findings, paths, references."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# ASCII word boundaries stand for \b, which is ASCII in the contract's dialect and not in Java's.
B, E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

# The secret patterns by code.
SECRET_PATTERNS = {
    "SECRET_PRIVATE_KEY": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "SECRET_BEARER": rf"(?i){B}(?:authorization\s*[:=]\s*)?bearer\s+[A-Za-z0-9._~+/=-]{{12,}}",
    "SECRET_AWS_KEY": rf"{B}(?:AKIA|ASIA)[A-Z0-9]{{16}}{E}",
    "SECRET_ASSIGNMENT": rf"(?i){B}(?:api[_-]?key|client[_-]?secret|password|token)\s*[:=]\s*[\"']?[A-Za-z0-9._~+/=-]{{12,}}",
}
# The prompt-injection patterns, all of one code.
INJECTION_CODE = "PROMPT_INJECTION"
INJECTION_PATTERNS = (
    rf"(?i){B}ignore (?:all |any )?(?:previous|prior|system|developer) instructions?{E}",
    rf"(?i){B}(?:reveal|print|return|exfiltrate) (?:the )?(?:secret|credential|system prompt|environment variable)",
    rf"(?i){B}(?:run|execute|spawn) (?:this |the )?(?:command|shell|script)",
    rf"(?i){B}(?:disable|bypass|override|alter) (?:the )?(?:policy|approval|guardrail|workflow state)",
)


# The characters under U+0300 that the compatibility form leaves alone, in ranges; the canonical form leaves all of those alone, if none from U+0300 on follows.
INERT = "\u0000-\u009f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0180-\u01c3\u01cd-\u01f0\u01f4-\u02af\u02b9-\u02d7\u02de\u02df\u02e5-\u02ff"


# Rows of plain functions go to Python a hundred at a time: a batch of Arrow would hold 10,000 whole texts.
@F.udf(StringType(), useArrow=False)
def _nfc(x: str | None) -> str | None:
    return None if x is None else unicodedata.normalize("NFC", x)


@F.udf(StringType(), useArrow=False)
def _nfkc(x: str | None) -> str | None:
    return None if x is None else unicodedata.normalize("NFKC", x)


def nfc(c: Column) -> Column:
    """NFC. Spark has no normalisation function, so texts that it can change go to Python, and others stay where they are."""
    return F.coalesce(_nfc(F.when((F.octet_length(c) > F.length(c)) & c.rlike("[^\u0000-\u02ff]"), c)), c)


def nfkc(c: Column) -> Column:
    """NFKC, in the same way."""
    return F.coalesce(_nfkc(F.when((F.octet_length(c) > F.length(c)) & c.rlike(f"[^{INERT}]"), c)), c)


@F.pandas_udf(ArrayType(StringType()))
def canonical_answers(s: pd.Series) -> pd.Series:
    """canonical_answer of each text of a list."""
    return s.map(lambda v: None if v is None else [" ".join(unicodedata.normalize("NFKC", x).split()) for x in v])


def strict_text(raw: Column, normalise: bool = True) -> Column:
    """Text of bytes that are UTF-8 without surrogates, in NFC; null for others."""
    good = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    return nfc(good) if normalise else good


def json_size(c: Column) -> Column:
    """UTF-8 bytes of a text as a JSON string: quotes, short escapes and escapes of six bytes included."""
    return F.octet_length(c) + 2 + F.regexp_count(c, F.lit('["\\\\\x08\t\n\x0c\r]')) + 5 * F.regexp_count(c, F.lit("[\\x00-\\x07\\x0b\\x0e-\\x1f]"))


def has_term(low: Column, term: str) -> Column:
    """Whether a lower-case text has a token: between blanks, else anywhere. The pattern begins with the term itself, so that its neighbours are looked at only where it stands."""
    token, quoted = r"[a-z0-9_\-\p{L}\p{N}]", f"\\Q{term}\\E"
    return F.coalesce(low.contains(f" {term} ") | (low.contains(term) & low.rlike(f"{quoted}(?!{token})(?<!{token}{quoted})")), F.lit(False))


def query_terms(query: str) -> list[str]:
    """The distinct tokens of a query, as terms() has them."""
    low = unicodedata.normalize("NFKC", query).lower()
    return list(dict.fromkeys("".join(ch if ch in "_-" or unicodedata.category(ch)[0] in "LN" else " " for ch in low).split()))


def byte_hash(c: Column) -> Column:
    """sha256:<hex> of the UTF-8 bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def utf16(c: Column) -> Column:
    """A key that sorts strings by their UTF-16 units: U+1F600 stands before U+FB01, where UTF-8 bytes have it after."""
    return F.encode(c, "UTF-16BE")


def ordered(df: DataFrame, name: str) -> Column:
    """The column as a sort key: strings by their UTF-16 units, all else as it is."""
    return utf16(F.col(name)) if df.schema[name].dataType == StringType() else F.col(name)


def utf16_sorted(c: Column) -> Column:
    """An array of strings by their UTF-16 units, nulls last."""
    keyed = F.array_sort(F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: F.struct(utf16(x).alias("k"), x.alias("v"))))
    return F.concat(F.transform(keyed, lambda x: x["v"]), F.filter(c, lambda x: x.isNull()))


def is_byte_hash(c: Column) -> Column:
    return F.coalesce(c.rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))


def short_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and the first 16 hexadecimal digits of the parts' hash, joined by a zero byte."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\0", *parts).cast("binary"), 256), 1, 16))


def canonical_text(c: Column, normalise: bool = True) -> Column:
    """NFC, LF only, exactly one LF at the end."""
    unix = F.regexp_replace(nfc(c) if normalise else c, r"\r\n?", "\n")
    return F.concat(F.regexp_replace(unix, r"\n+\z", ""), F.lit("\n"))


def terms(c: Column, normalise: bool = True) -> Column:
    """Distinct lower-case tokens, in the order of their first place."""
    return F.array_distinct(F.regexp_extract_all(F.lower(nfkc(c) if normalise else c), F.lit(r"[a-z0-9_\-\p{L}\p{N}]+"), F.lit(0)))


def content_strings(c: Column) -> Column:
    """All strings of a JSON text, keys and values at any depth, as they stand there; JSON that doesn't parse is one string, and null has none.

    Escaped backslashes and quotes are set aside as control characters, which no JSON string
    holds as such, so that the pattern of a string has no alternatives to go back to.
    """
    bare = F.replace(F.replace(c, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    literals = F.regexp_extract_all(bare, F.lit('"([^"]*+)"'), F.lit(1))

    def value(x: Column) -> Column:
        whole = F.replace(F.replace(x, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
        return F.when(F.contains(whole, F.lit("\\")), F.get_json_object(F.concat(F.lit('["'), whole, F.lit('"]')), "$[0]")).otherwise(whole)

    found = F.when(F.try_parse_json(c).isNull(), F.array(c)).otherwise(F.transform(literals, value))
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(found)


def content_text(c: Column) -> Column:
    """The strings of a JSON text, joined by line feeds: what the checks for secrets and injections of a nested value see."""
    return F.array_join(content_strings(c), "\n")


# What a text with a secret of each code has in it, in lower case: a cheap test before the patterns.
SECRET_STEMS = {"SECRET_PRIVATE_KEY": ("private key-----",), "SECRET_BEARER": ("bearer",), "SECRET_AWS_KEY": ("akia", "asia"), "SECRET_ASSIGNMENT": ("key", "secret", "password", "token")}


def secret_hits(c: Column) -> dict[str, Column]:
    """By code, whether a text has its pattern; the pattern is tried only where its stem stands."""
    low, out = F.lower(c), {}
    for code, pattern in SECRET_PATTERNS.items():
        stem = F.lit(False)
        for s in SECRET_STEMS[code]:
            stem = stem | low.contains(s)
        out[code] = F.coalesce(stem & c.rlike(pattern), F.lit(False))
    return out


def secret_codes(c: Column) -> Column:
    return F.array_compact(F.array(*[F.when(hit, F.lit(code)) for code, hit in secret_hits(c).items()]))


def injection_codes(c: Column) -> Column:
    hit = F.lit(False)
    for p in INJECTION_PATTERNS:
        hit = hit | c.rlike(p)
    return F.when(hit, F.array(F.lit(INJECTION_CODE))).otherwise(F.array().cast("array<string>"))


def markdown_text(c: Column, normalise: bool = True) -> Column:
    """Brackets and backslashes escaped, blanks collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(nfc(c) if normalise else c, r"([\[\]\\])", r"\\$1"), r"\s+", " "))


def directory_title(path: Column) -> Column:
    """Words between - and _ of the last part, each with its first letter in upper case."""
    parts = F.filter(F.split(F.element_at(F.split(path, "/"), -1), "[-_]"), lambda x: x != "")
    return F.when(path == "", F.lit("Knowledge Index")).otherwise(F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), " "))


def canonical_answer(c: Column) -> Column:
    return F.trim(F.regexp_replace(nfkc(c), r"\s+", " "))


def links(c: Column) -> Column:
    """Targets of inline links, without query and anchor; those with a scheme are left out."""
    raw = F.transform(F.regexp_extract_all(c, F.lit(r"\[[^\]]*\]\(([^)]+)\)"), F.lit(1)), lambda x: F.regexp_replace(F.trim(x), r"[?#].*$", ""))
    return F.filter(raw, lambda x: (x != "") & ~x.rlike("(?i)^[a-z][a-z0-9+.-]*:"))


def living_reference(c: Column) -> Column:
    """A reference without its first revision (@... up to the next slash)."""
    return F.regexp_replace(c, r"(?s)^(.*?)@[^/]+/(.*)$", "$1/$2")


def clean_concept_id(c: Column) -> Column:
    """A percent-decoded concept path without .md; null if it leaves its root, has an empty part, a backslash or a NUL, or can't be decoded."""
    plain = F.when(~c.rlike(r"%(?![0-9A-Fa-f]{2})"), F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))))
    bad = (plain == "") | plain.startswith("/") | plain.contains("\\") | plain.contains("\0") | F.exists(F.split(plain, "/"), lambda x: x.isin("", ".", ".."))
    return F.nullif(F.when(~bad, F.regexp_replace(plain, r"[.]md$", "")), F.lit(""))


def kb_reference(c: Column) -> Column:
    """struct(id, version, concept_id) of kb://id[@version]/concept; null if it is not one."""
    ok = c.rlike(r"^kb://[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?(?:@[^/?#]+)?/[^?#]+$")
    part = lambda k: F.regexp_extract(c, r"^kb://([a-z0-9](?:[a-z0-9.-]*[a-z0-9])?)(?:@([^/?#]+))?/([^?#]+)$", k)
    return F.when(ok, F.struct(part(1).alias("id"), F.nullif(part(2), F.lit("")).alias("version"), F.regexp_replace(part(3), r"\.md$", "").alias("concept_id")))


def subject_path(c: Column) -> Column:
    """A subject as a file name: lower case, runs of anything else a dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9/_-]+", "-"), r"^-+|-+$", "")


def pointer_unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def visible_lines(body: Column) -> Column:
    """The lines outside fences, without inline code; a fence closes at a line with its own mark."""
    lines = F.split(F.regexp_replace(body, r"\r\n?", "\n"), "\n")
    mark = lambda x: F.substring(F.regexp_extract(x, r"^\s*(`{3,}|~{3,})", 1), 1, 1)
    start = F.struct(F.lit("").alias("fence"), F.array().cast("array<string>").alias("out"))
    step = lambda acc, x: F.struct(
        F.when(mark(x) == "", acc["fence"]).when(acc["fence"] == "", mark(x)).when(acc["fence"] == mark(x), F.lit("")).otherwise(acc["fence"]).alias("fence"),
        F.concat(acc["out"], F.array(F.when((mark(x) != "") | (acc["fence"] != ""), F.lit("")).otherwise(F.regexp_replace(x, "`+[^`]*`+", "")))).alias("out"),
    )
    return F.aggregate(lines, start, step)["out"]


def citations(body: Column) -> Column:
    """Distinct footnote labels outside code."""
    return F.array_distinct(F.regexp_extract_all(F.array_join(visible_lines(body), "\n"), F.lit(r"\[\^([^\]\s]+)\]"), F.lit(1)))


def secret_looking(c: Column) -> Column:
    """Values that look like credentials and not like names of environment variables."""
    marked = c.rlike(r"BEGIN [A-Z ]*PRIVATE KEY|eyJ[A-Za-z0-9_-]{10,}\.|://[^/\s]+:[^@\s]+@")
    mixed = (F.length(c) >= 24) & ~c.rlike(r"\s") & c.rlike("[a-z]") & c.rlike("[A-Z0-9]") & ~c.rlike("^[A-Z][A-Z0-9_]{2,63}$") & ~c.rlike("^https://")
    return F.coalesce(marked | mixed, F.lit(False))


def redirects_out(path: Column) -> Column:
    """Whether a relative path leaves its root or is not one."""
    return F.coalesce(path.startswith("/") | path.contains("\\") | path.rlike(r"(^|/)\.\.(/|$)|(^|/)\.(/|$)|//"), F.lit(True))

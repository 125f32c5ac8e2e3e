"""Text expressions: Python's white space, words, record views, redaction patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The code points that Python's str.strip and str.split treat as white space.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: The same as characters.
WS_CHARS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

#: Patterns of personal data, applied in this order.
PII = {
    "EMAIL_ADDRESS": r"(?iuU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "PHONE_NUMBER": r"(?U)(?<!\w)(?:\+?\d[\d .()\-]{7,}\d)(?!\w)",
    "IP_ADDRESS": r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "CREDIT_CARD": r"(?U)\b(?:\d[ -]*?){13,19}\b",
    "API_KEY": r"(?:AIza[0-9A-Za-z\-_]{35}|hf_[A-Za-z0-9]{34}|sk-[A-Za-z0-9\-_]{48}|sk-proj-[A-Za-z0-9\-_]{48,}|sk-ant-[A-Za-z0-9\-_]{48,})",
}
#: Entities that identify a person, the only ones redacted in labelled data.
IDENTIFIERS = ("API_KEY", "CREDIT_CARD", "EMAIL_ADDRESS", "IBAN_CODE", "IP_ADDRESS", "PHONE_NUMBER", "US_BANK_NUMBER", "US_ITIN", "US_PASSPORT", "US_SSN")
#: Secrets to mask in logs, with their replacements.
SECRETS = [
    (r"(?i)(bearer\s+)[^\s\"'<>]+", "$1[REDACTED]"),
    (r"(?:sk-(?:ant-|proj-)?|ctx7sk-|hf_|AIza)[A-Za-z0-9_\-]{8,}", "[REDACTED]"),
    (r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", "[REDACTED]"),
    (r"(?i)([?&](?:token|key|api_key|access_token|signature)=)[^&\s]+", "$1[REDACTED]"),
]


def strip(text: Column) -> Column:
    """str.strip(): only the ends of a text are looked at."""
    return F.btrim(text, F.lit(WS_CHARS))


def split_words(text: Column) -> Column:
    """str.split(): project the result before using it inside a higher-order function."""
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def two_places(x: Column) -> Column:
    """A double with two decimals as C's printf writes it, by its exact value (format_string rounds its shortest digits: 0.285, which is less, gives 0.29).

    The value is compared with the middle of two neighbours, (2 k + 1) / 200. Where it is the double next to it, the sign of
    200 x - (2 k + 1) decides, exact in two parts of x; a middle itself goes to the even neighbour.
    """
    a = F.abs(x)
    k = F.floor(a * 100).cast("double")
    odd = 2 * k + 1
    high = a.cast("float").cast("double")
    rest = (high * 200 - odd) + (a - high) * 200
    up = (rest > 0) | ((rest == 0) & (k % 2 == 1))
    n = (k + F.when(up, 1.0).otherwise(0.0)).cast("long")
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    exact = F.format_string("%s%d.%02d", sign, F.floor(n / 100), n % 100)
    return F.when(a < 1e12, exact).otherwise(F.format_string("%.2f", x))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def may_match(name: str, text: Column) -> Column:
    """Whether a text has the signs without which a pattern can't match: cheap to find, so that most texts meet few patterns.

    Replacements add none of these signs, so it may look at the text before them.
    """
    if name == "EMAIL_ADDRESS":
        return F.contains(text, F.lit("@"))
    if name == "API_KEY":
        return F.contains(text, F.lit("sk-")) | F.contains(text, F.lit("hf_")) | F.contains(text, F.lit("AIza"))
    if name in ("PHONE_NUMBER", "IP_ADDRESS", "CREDIT_CARD"):
        return F.rlike(text, F.lit(r"(?U)\d"))
    return F.lit(True)


def _step(name: str, pattern: str):
    return lambda t: F.when(may_match(name, t), F.regexp_replace(t, pattern, f"<{name}>")).otherwise(t)


def redact(text: Column, entities: list[str] | None = None, patterns: dict[str, str] | None = None) -> Column:
    """Replace what each pattern finds in turn by <ENTITY>; later patterns see the replaced text.

    Each step binds its text by a one-element transform: the expression stays as long as the list of patterns.
    """
    for name, pattern in (patterns or PII).items():
        if entities is None or name in entities:
            text = F.transform(F.array(text), _step(name, pattern))[0]
    return text


def redaction_steps(df: DataFrame, text: str, entities: list[str] | None = None, patterns: dict[str, str] | None = None) -> DataFrame:
    """df with text redacted and one column n_<entity> of matches per pattern, counted in the text as the patterns before leave it.

    Each step is a column of its own, so that a step's text is made once.
    """
    for k, (name, pattern) in enumerate((patterns or PII).items()):
        if entities is None or name in entities:
            found = F.when(may_match(name, F.col(text)), F.regexp_count(text, F.lit(pattern))).otherwise(0)
            df = df.withColumn(f"n_{name.lower()}", found)
            df = df.withColumn(text, F.when(F.col(f"n_{name.lower()}") > 0, F.regexp_replace(text, pattern, f"<{name}>")).otherwise(F.col(text)))
    return df


def mask_secrets(text: Column) -> Column:
    for pattern, new in SECRETS:
        text = F.regexp_replace(text, pattern, new)
    return text


def normalised_tokens(text: Column) -> Column:
    """Lower-case tokens of letters, digits, _ and ', one space apart."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_']+)")), " ")

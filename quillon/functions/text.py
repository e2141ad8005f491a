"""Text and query-language functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, as a pattern: control spaces, the separators of Unicode.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
RUN = r"[\p{L}\p{N}]+"
#: Characters that count as digits, those of decimal systems and those that stand for one digit.
DIGIT = r"[\p{Nd}\u00b2\u00b3\u00b9\u1369-\u1371\u19da\u2070\u2074-\u2079\u2080-\u2089\u2460-\u2468\u2474-\u247c\u2488-\u2490\u24ea\u24f5-\u24fd\u24ff\u2776-\u277e\u2780-\u2788\u278a-\u2792]"
#: The supported file types.
TYPES = ("pdf", "docx", "txt")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """Every run of white space becomes one space; none at the ends. A single space is no match, so that most of a text is passed over."""
    return F.trim(F.regexp_replace(c, f"{SPACE}(?:{SPACE}+|(?<! ))", " "))


def name_tokens(c: Column) -> Column:
    """Runs of letters and digits in lower case, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(c), F.lit(RUN), F.lit(0))


def content_tokens(c: Column) -> Column:
    """The same without tokens of one character."""
    return F.filter(name_tokens(c), lambda x: F.length(x) > 1)


def is_number(c: Column) -> Column:
    return c.rlike(f"^{DIGIT}+$")


def extension(c: Column) -> Column:
    """File type in lower case; leading dots start no extension."""
    return F.lower(F.regexp_extract(c, r"[^.].*\.([^.]*)$", 1))


def stem(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=[^.])(\.[^.]*)$", "")


def _without_suffix(c: Column, n: int) -> Column:
    return rstrip(F.substring(c, F.lit(1), F.length(c) - n))


def file_type(raw: Column) -> Column:
    """struct(rest, filetype): what a query asks for besides a file type, and the type or null.

    A type stands at the end of the last word, also inside closing quotes, or alone as a word anywhere; of several
    words the first one counts and all go.
    """
    q = strip(raw)
    low = F.lower(q)
    words = F.filter(F.split(q, f"{SPACE}+"), lambda w: w != "")
    alone = lambda w: F.lower(w).isin(*TYPES, *[f".{t}" for t in TYPES])
    rest = F.array_join(F.filter(words, lambda w: ~alone(w)), " ")
    out = F.struct(F.when(F.size(words) > 0, rest).otherwise(q).alias("rest"), F.when(F.size(F.filter(words, alone)) > 0, F.regexp_replace(F.lower(F.try_element_at(F.filter(words, alone), F.lit(1))), r"^\.", "")).alias("filetype"))
    for t in reversed(TYPES):
        n = len(t) + 1
        cut = _without_suffix(q, n + 1)
        quoted = F.struct(F.when(cut != "", F.concat(cut, F.lit('"'))).otherwise(F.lit("")).alias("rest"), F.lit(t).alias("filetype"))
        out = F.when(low.endswith(f'.{t}"'), quoted).when(low.endswith(f".{t}"), F.struct(_without_suffix(q, n).alias("rest"), F.lit(t).alias("filetype"))).otherwise(out)
    return out


def normalise_query(c: Column) -> Column:
    """Without one file extension at the end, inside quotes or not, and without outer white space."""
    q = strip(c)
    wrapped = (F.length(q) >= 2) & q.startswith('"') & q.endswith('"')
    inner = F.when(wrapped, strip(F.substring(q, F.lit(2), F.length(q) - 2))).otherwise(q)
    bare = F.regexp_replace(inner, r"(?i)\.(pdf|docx|txt)$", "")
    bare = F.when(bare != inner, rstrip(bare)).otherwise(inner)
    return F.when(wrapped, F.concat(F.lit('"'), bare, F.lit('"'))).otherwise(bare)


def quoted_part(c: Column) -> Column:
    """What a query in quotes has inside, or null."""
    return F.when((F.length(c) >= 2) & c.startswith('"') & c.endswith('"'), strip(F.substring(c, F.lit(2), F.length(c) - 2)))


def occurrences(text: Column, phrase: Column) -> Column:
    """Non-overlapping occurrences of a phrase in a collapsed lower-case text; 0 for an empty phrase."""
    return F.when(F.length(phrase) > 0, ((F.length(text) - F.length(F.replace(text, phrase, F.lit("")))) / F.length(phrase)).cast("int")).otherwise(F.lit(0))


def url_quote(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def page_number(c: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(strip(c).try_cast("int"), F.lit(1)))


def page_limit(c: Column) -> Column:
    return F.least(F.lit(50), F.greatest(F.lit(1), F.coalesce(strip(c).try_cast("int"), F.lit(10))))

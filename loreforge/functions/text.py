"""Column expressions on texts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"
#: A word that names a secret, then what is assigned to it.
SECRET = r"(?i)(?:api[_-]?key|access[_-]?key|secret|token|password|passwd)[\x22\x27]?[ \t]*[:=][ \t]*[\x22\x27]?[A-Za-z0-9_./+=-]{8,}"
KEY = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----"
CARD = r"[0-9]{4}(?:[ -][0-9]{4}){3}"
ACCOUNT = r"[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){3,7}"
IPV4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
#: In the order in which they are masked. The same in Java's and DuckDB's dialect.
PATTERNS = {"key": KEY, "secret": SECRET, "email": EMAIL, "account": ACCOUNT, "card": CARD, "phone": PHONE, "ip": IPV4}


def tokens(text) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.col(text) if isinstance(text, str) else text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def line(text) -> Column:
    """:func:`tokens`, space-joined; null counts as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def with_array(df: DataFrame, name: str, array: Column) -> DataFrame:
    """df with an array column that later expressions don't compute again: a generator stands between."""
    return df.select("*", F.explode(F.array(array)).alias(name))


def shingles(words: str, n: int) -> Column:
    """Of an array column: each n words in a row, space-joined; none if there are fewer."""
    grams = F.transform(F.col(words), lambda _, i: F.array_join(F.slice(F.col(words), i + 1, n), " "))
    return F.slice(grams, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))

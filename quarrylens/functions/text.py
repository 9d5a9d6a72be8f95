"""Column expressions over text: redaction, identifiers, digests, estimates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = "[REDACTED]"

# What names a secret, and the shapes in which secrets stand in text.
SECRET_WORDS = r"pass(?:word|wd)?|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|client[_-]?secret|private[_-]?key|credential(?:s)?|authorization|auth|bearer|session[_-]?id|connection[_-]?string|conn[_-]?str"
BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._\-]{8,}"
KEY_VALUE = rf"""(?i)(\b[A-Za-z0-9_]*(?:{SECRET_WORDS})\b)("?)((?:\s+As\s+[A-Za-z0-9_()]+)?\s*[:=]\s*)(?:(")[^"]*"|(')[^']*'|[^\s,;&)"']+)"""
JDBC = r"""(?i)(jdbc:[a-z0-9]+://[^\s;"']+?);(?:(?:password|pwd|user|username)\s*=\s*[^\s;"']+)+"""
USER_INFO = r"([a-zA-Z][a-zA-Z0-9+.\-]*://)[^/\s:@]+:[^/\s:@]+@"
SECRET_NAME = rf"(?i)^[A-Za-z0-9_ ]*(?:{SECRET_WORDS})[A-Za-z0-9_ ]*$"


def redact(text: Column | str) -> Column:
    """The text with secrets replaced; bearer tokens first, so that a header's value does not hide them."""
    c = F.col(text) if isinstance(text, str) else text
    c = F.regexp_replace(c, BEARER, f"Bearer {PLACEHOLDER}")
    # the two patterns that try every word run only where their fixed part occurs
    c = F.when(c.rlike(f"(?i){SECRET_WORDS}"), F.regexp_replace(c, KEY_VALUE, f"$1$2$3$4$5{PLACEHOLDER}$4$5")).otherwise(c)
    c = F.regexp_replace(c, JDBC, f"$1;{PLACEHOLDER}")
    return F.when(F.contains(c, F.lit("://")), F.regexp_replace(c, USER_INFO, f"$1{PLACEHOLDER}@")).otherwise(c)


def redact_map(m: Column | str) -> Column:
    """A map of strings with redacted values; of a key that names a secret the whole value goes."""
    return F.transform_values(m, lambda k, v: F.when(F.trim(k).rlike(SECRET_NAME), F.lit(PLACEHOLDER)).otherwise(redact(v)))


def redact_json(text: Column | str) -> Column:
    """JSON text, nested to any depth, redacted like redact_map; containers under a secret's name are left out."""

    @F.pandas_udf("string")
    def run(values: pd.Series, flat: pd.Series) -> pd.Series:
        import json
        import re

        patterns = [(re.compile(p), r) for p, r in ((BEARER, f"Bearer {PLACEHOLDER}"), (KEY_VALUE, None), (JDBC, rf"\1;{PLACEHOLDER}"), (USER_INFO, rf"\1{PLACEHOLDER}@"))]
        name = re.compile(SECRET_NAME)

        def plain(s: str) -> str:
            for p, r in patterns:
                s = p.sub(r if r else lambda m: "".join(m[i] or "" for i in range(1, 6)) + PLACEHOLDER + (m[4] or m[5] or ""), s)
            return s

        def walk(x):
            if isinstance(x, dict):
                return {k: (f"{PLACEHOLDER} ({type(v).__name__} omitted)" if isinstance(v, (dict, list)) else PLACEHOLDER) if name.match(k.strip()) else walk(v) for k, v in x.items()}
            if isinstance(x, list):
                return [walk(v) for v in x]
            return plain(x) if isinstance(x, str) else x

        def one(s, f):
            if s is None:
                return None
            try:
                return json.dumps(walk(json.loads(s)), ensure_ascii=False)
            except ValueError:
                return f

        return pd.Series([one(s, f) for s, f in zip(values, flat)])

    return run(text, redact(text))


def slug(text: Column | str) -> Column:
    """Upper-case identifier of ASCII text: other runs to "_", trimmed, 60 characters at most, "UNNAMED" if empty."""
    c = F.col(text) if isinstance(text, str) else text
    c = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_")
    c = F.upper(F.regexp_replace(c, "^_+|_+$", ""))
    c = F.regexp_replace(F.substring(c, 1, 60), "_+$", "")
    return F.when(c == "", F.lit("UNNAMED")).otherwise(c)


def slug_text(text: str) -> str:
    """The same of any text, with accents taken off first."""
    ascii_ = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode().lower()
    out = "".join(c if c.isalnum() else " " for c in ascii_).split()
    return "_".join(out).upper()[:60].rstrip("_") or "UNNAMED"


def slug_unicode(text: Column | str) -> Column:
    """slug_text as a column; only NFKD needs Python."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(slug_text, na_action="ignore")

    return run(text)


def token_estimate(text: Column | str) -> Column:
    """A quarter of the characters, rounded up."""
    return F.expr("(length({0}) + 3) DIV 4".format(text)) if isinstance(text, str) else F.floor((F.length(text) + 3) / 4)


def fingerprint(text: Column | str, size: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, size)


def coerce(value: Column) -> Column:
    """Null as empty text, anything else as text."""
    return F.coalesce(value.cast("string"), F.lit(""))


def camel(name: Column | str) -> Column:
    """Letters and digits of a name as one lowerCamelCase word; "rule" in front of a digit or of nothing."""
    c = F.col(name) if isinstance(name, str) else name
    words = F.filter(F.split(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    base = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")
    base = F.when(base == "", F.lit("Rule")).when(base.rlike(r"^\p{N}"), F.concat(F.lit("rule"), base)).otherwise(base)
    return F.concat(F.lower(F.substring(base, 1, 1)), F.substring(base, 2, 1 << 30))

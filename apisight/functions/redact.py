"""Masking of secrets and e-mail addresses in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from apisight.ruleset import OPAQUE_SECRET_MIN_LEN, REDACTED, REDACTED_PATH, SENSITIVE_FIELD_NAMES

_TOKEN = r"[A-Za-z0-9_+/=-]"
#: A JWT, an opaque token with a digit, or an e-mail address.
SECRET = (
    r"(?s)^(?:[A-Za-z0-9_-]{4,}(?:\.[A-Za-z0-9_-]{4,}){2}\z"
    rf"|(?=[^0-9]*[0-9]){_TOKEN}{{{OPAQUE_SECRET_MIN_LEN},}}\z"
    r"|[^@]+@(?!\.)[^.]*\.)"
)
#: What every word that is masked in some part holds: =, @, a run of token characters or two of them about a dot.
CANDIDATE = rf"[=@]|{_TOKEN}{{{OPAQUE_SECRET_MIN_LEN}}}|[A-Za-z0-9_-]{{4}}\.[A-Za-z0-9_-]{{4}}"
PUNCTUATION = ",;:.!?()[]\"'"


def is_secret_like(part: Column) -> Column:
    value = F.btrim(part, F.lit(PUNCTUATION))
    return value.rlike(SECRET) | F.exists(F.split(value, "%[0-9A-Fa-f]{2}"), lambda x: x.rlike(SECRET))


def is_sensitive_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", "")).rlike("|".join(SENSITIVE_FIELD_NAMES))


def _part(part: Column) -> Column:
    at = F.instr(part, "=")
    name = part.substr(F.lit(1), at - 1)
    pair = (at > 0) & (F.length(part) > at) & is_sensitive_name(name)
    return F.when(pair, F.concat(name, F.lit(f"={REDACTED}"))).when(is_secret_like(part), F.lit(REDACTED)).otherwise(part)


def redact_text(text: Column) -> Column:
    """Every word (up to a space or tab) with its secrets masked: of a word with slashes each segment, of name=value the value.

    Texts, and words, that can't hold a secret (see CANDIDATE) are left after one look.
    """
    chunks = F.regexp_extract_all(text, F.lit("[^ \t]*[ \t]|[^ \t]+"), 0)

    def word(chunk: Column) -> Column:
        body = F.regexp_replace(chunk, r"(?U)\s+\z", "")
        tail = chunk.substr(F.length(body) + 1, F.length(chunk))
        masked = F.array_join(F.transform(F.split(body, "/"), _part), "/")
        # most words are short and have none of these, which is cheaper to see than that the pattern fails
        likely = (F.length(chunk) >= OPAQUE_SECRET_MIN_LEN) | F.contains(chunk, F.lit(".")) | F.contains(chunk, F.lit("=")) | F.contains(chunk, F.lit("@"))
        return F.when(likely & chunk.rlike(CANDIDATE), F.concat(masked, tail)).otherwise(chunk)

    return F.when(text.rlike(CANDIDATE), F.array_join(F.transform(chunks, word), "")).otherwise(text)


def redact_file(path: Column) -> Column:
    """A file path's name behind a mask for its folders; a name or stem that looks secret is masked."""
    name = F.substring_index(path, "/", -1)
    stem = F.regexp_replace(name, r"(?s)\.[^.]*\z", "")
    shown = F.when(is_secret_like(name) | is_secret_like(stem), F.lit(REDACTED)).otherwise(name)
    return F.when(name == "", F.lit(REDACTED_PATH)).when(F.contains(path, F.lit("/")), F.concat(F.lit(f"{REDACTED_PATH}/"), shown)).otherwise(shown)

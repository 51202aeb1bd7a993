"""Masking of secrets in text, as chains of regexp_replace behind a cheap test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
ACCESS_KEY = r"AKIA[0-9A-Z]{16}"
CONTACTS = f"{EMAIL}|{ACCESS_KEY}"
#: Shapes of well-known credentials (fixed values); repetitions are bounded where the shape allows it.
SECRET_SHAPES = {
    "access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "forge_token": r"\bgh[pousr]_[A-Za-z0-9]{36,255}\b|\bgithub_pat_[A-Za-z0-9_]{22,255}\b",
    "chat_token": r"\bxox[abeoprs]-[A-Za-z0-9-]{10,250}\b",
    "model_key": r"\bsk-[A-Za-z0-9_-]{20,250}",
    "map_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "web_token": r"\beyJ[A-Za-z0-9_-]{8,2000}\.[A-Za-z0-9_-]{8,4000}\.[A-Za-z0-9_-]{8,1000}",
    "bearer": r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{16,2000}",
    "private_key": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[\s\S]{0,20000}?(?:-----END [A-Z ]{0,40}PRIVATE KEY-----|$)",
}
ASSIGNED = r"""(?i)\b([A-Za-z0-9_.-]{0,60}(?:password|passwd|secret|token|api[_-]?key|access[_-]?key)[A-Za-z0-9_-]{0,30})(["']?\s{0,3}[:=]\s{0,3}["']?)([^\s"',;]{6,500})"""
#: What any of the shapes must contain; texts without it are not looked at again.
HINT = r"(?i)akia|asia|gh[pousr]_|github_pat|xox[abeoprs]-|sk-|aiza|eyj|bearer|private key|passw|secret|token|key"
MASK = "[masked]"


def mask_contacts(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, EMAIL, "[EMAIL]"), ACCESS_KEY, "[KEY]")


def mask_secrets(text: Column) -> Column:
    """Credentials replaced by a mark, assigned ones after their name (278)."""
    out = text
    for shape in SECRET_SHAPES.values():
        out = F.regexp_replace(out, shape, MASK)
    out = F.regexp_replace(out, ASSIGNED, rf"$1$2{MASK}")
    return F.when(F.rlike(text, F.lit(HINT)), out).otherwise(text)


def mask_array(texts: Column) -> Column:
    """The same for every string of an array (279)."""
    return F.transform(texts, mask_secrets)

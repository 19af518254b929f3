"""Which grammar a path has."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammars and their extensions.
EXTENSIONS = {
    "php": "php", "javascript": "js mjs cjs jsx", "typescript": "ts tsx mts cts", "python": "py", "rust": "rs", "cpp": "cpp cc cxx hpp hh hxx h c inl", "go": "go", "java": "java", "ruby": "rb rake", "c_sharp": "cs", "bash": "sh bash",
}


def suffixes(overrides: dict[str, str] | None = None) -> dict[str, str]:
    """suffix with its dot -> grammar, overrides last."""
    known = {f".{e}": lang for lang, ext in EXTENSIONS.items() for e in ext.split()}
    return known | {("." + k.lstrip(".")): v for k, v in (overrides or {}).items()}


def detect(path: Column, overrides: dict[str, str] | None = None) -> Column:
    """The grammar of the longest suffix that fits, an override before a known one; null if none does. Case counts."""
    own = {("." + k.lstrip(".")): v for k, v in (overrides or {}).items()}
    out = F.lit(None).cast("string")
    for s, lang in sorted(suffixes().items(), key=lambda x: len(x[0])):
        out = F.when(path.endswith(s), lang).otherwise(out)
    for s, lang in sorted(own.items(), key=lambda x: len(x[0])):
        out = F.when(path.endswith(s), lang).otherwise(out)
    return out


def detect_one(path: str, overrides: dict[str, str] | None = None) -> str | None:
    for table in ({("." + k.lstrip(".")): v for k, v in (overrides or {}).items()}, suffixes()):
        fits = [s for s in table if path.endswith(s)]
        if fits:
            return table[max(fits, key=len)]
    return None


def load_config(text: str | None, limit: int = 64 * 1024) -> dict:
    """extensions and auto_import of a repository's JSON settings; no text gives the defaults, a wrong one raises."""
    if text is None:
        return {"extensions": {}, "auto_import": True}
    if len(text.encode()) > limit:
        raise ValueError(f"the settings are over {limit} bytes")
    raw = json.loads(text)
    ext = raw.get("extensions", {})
    if not isinstance(ext, dict) or any(v not in EXTENSIONS for v in ext.values()):
        raise ValueError(f"extensions must map suffixes to one of {', '.join(sorted(EXTENSIONS))}")
    return {"extensions": ext, "auto_import": bool(raw.get("auto_import", True))}

"""Absolute local paths in text: recognition and scrubbing on the JVM side."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from evidmill.functions.detectors import HOME_PATH

PLACEHOLDER = "[REDACTED:abs_path]"
# Absolute paths and file addresses, with the last segment captured so that the base name survives.
_ABS_TAIL = r"""(?U)(?<![\w./:}\]-])/[^/\s\x1c-\x1f:"'\\]+(?:/[^/\s\x1c-\x1f:"'\\]+)*/([^/\s\x1c-\x1f:"'\\]+)"""
_URI_TAIL = r"""(?U)\bfile://(?:/[^/\s\x1c-\x1f:"'\\]+)*/([^/\s\x1c-\x1f:"'\\]+)"""
# Fixed value: what may stand below a known root, up to the base name.
_BELOW = r"""(?:[^/\s\x1c-\x1f:"'\\]+/)*([^/\s\x1c-\x1f:"'\\]+)(?![\w])"""


def scrub_local_paths(value: Column, roots: tuple[str, ...] = ()) -> Column:
    """Directories of absolute paths replaced, base names and ``file://`` kept."""
    mark = PLACEHOLDER + "/$1"
    out = value
    known = sorted({r.rstrip("/") for r in roots if r.startswith("/") and r.rstrip("/")}, key=len, reverse=True)
    if known:
        names = "|".join(re.escape(r.rsplit("/", 1)[0]) + "/(?=" + re.escape(r.rsplit("/", 1)[1]) + r"(?![\w]))" for r in known)
        tail = r"(?U)(?<![\w./:\]-])(?:" + names + ")" + _BELOW
        out = F.regexp_replace(out, F.lit(tail), F.lit(mark))
    out = F.regexp_replace(out, F.lit(_URI_TAIL), F.lit("file://" + mark))
    return F.regexp_replace(out, F.lit(_ABS_TAIL), F.lit(mark))


def mask_home(value: Column) -> Column:
    """Home folders collapse to a variable name."""
    return F.regexp_replace(value, F.lit(HOME_PATH), F.lit(r"\${HOME}"))


# Fixed value: JSON keys whose string value may hold a prompt.
PROMPT_FRAGMENT = r'(?i)"(?:prompt(?:_text|_body|_content)?|raw_prompt|system_prompt|user_prompt)"\s*:\s*"[^"]*"'


def strip_prompts(text: Column) -> Column:
    """Prompt-like JSON fragments are replaced, home folders masked."""
    return F.regexp_replace(mask_home(text), F.lit(PROMPT_FRAGMENT), F.lit('"prompt_redacted": "<redacted>"'))


def report_path(path: Column, repo_root: str | None = None) -> Column:
    """A path for a report: relative to the repository, else scrubbed."""
    clean = scrub_local_paths(mask_home(path))
    if not repo_root:
        return clean
    root = repo_root.rstrip("/")
    inside = F.concat(F.lit("<repo>"), F.substr(path, F.lit(len(root) + 1)))
    return F.when(path.startswith(root), inside).otherwise(clean)

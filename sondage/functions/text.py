"""Text expressions: JVM-side, no UDF."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words, split characters and page patterns that results depend on.
STOP_WORDS = (
    "and the a an of to in is it that "
    "und der die das ein eine ist es dass von zu mit auf für den dem des im am"
).split()
PUNCTUATION = ".,!?;:-_()[]{}"
SCRIPT = r"(?i)<script[^>]*>[\s\S]*?</script>"
STYLE = r"(?i)<style[^>]*>[\s\S]*?</style>"
LINE_BREAK = r"(?i)<br\s*/?>"
BLOCK_START = r"(?i)<(?:hr|p|div|h[1-6]|li|tr)[^>]*>"
TAG = r"<[^>]+>"
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))
SNIPPET_CHARS = 300


def collapse_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def html_to_text(html: Column) -> Column:
    """Minimal page text: scripts and styles out, blocks to lines, six entities, in this order."""
    for pattern, by in ((SCRIPT, ""), (STYLE, ""), (LINE_BREAK, "\n"), (BLOCK_START, "\n"), (TAG, "")):
        html = F.regexp_replace(html, pattern, by)
    for entity, char in ENTITIES:
        html = F.replace(html, F.lit(entity), F.lit(char))
    return F.regexp_replace(collapse_newlines(html), r"^\s+|\s+$", "")


def frontmatter_sha256(text: Column) -> Column:
    """The sha256 of a leading --- block in lower case, '' if there is none."""
    block = F.regexp_extract(text, r"(?s)^---\s*\n(.*?)\n---\s*(\n|$)", 1)
    return F.lower(F.regexp_extract(block, r'(?m)^sha256:\s*"?([0-9a-fA-F]{64})"?\s*$', 1))


def word_string(text: Column) -> Column:
    """Every token between its own two spaces, so a phrase is a substring and its count a substring count."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), r"[^\p{L}\p{N}]+", "  ")


def phrase(token: str) -> str:
    words = re.findall(r"[^\W_]+", token.lower())
    return " " + "  ".join(words) + " " if words else ""


def occurrences(words: Column, of: str) -> Column:
    return ((F.length(words) - F.length(F.replace(words, F.lit(of), F.lit("")))) / len(of)).cast("int")


def snippet(text: Column, terms: list[str], bound: int = SNIPPET_CHARS) -> Column:
    """Window of ``bound`` code points around the first case-insensitive hit of any term."""
    bound = bound if bound > 0 else SNIPPET_CHARS
    words = list(dict.fromkeys(w for t in terms for w in t.split()))
    head = F.substring(text, 1, bound)
    if not words:
        return F.when(F.length(text) <= bound, text).otherwise(head)
    hits = [F.nullif(F.locate(w.lower(), F.lower(text)), F.lit(0)) for w in words]
    first = (F.least(*hits) if len(hits) > 1 else hits[0]) - 1
    start = F.greatest(F.lit(0), F.least(F.greatest(F.lit(0), first - bound // 2), F.length(text) - bound))
    return F.when(F.length(text) <= bound, text).otherwise(F.coalesce(F.substring(text, start + 1, F.lit(bound)), head))


def glob_regex(pattern: str) -> str:
    """Anchored regex of a path pattern in which ** stands for any number of segments."""
    parts = pattern.split("/")
    out = []
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out.append(r"(?:[^/]+(?:/[^/]+)*)?" if last else r"(?:[^/]+/)*")
        else:
            piece = re.escape(part).replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
            follow = "" if last else "/"
            if not last and parts[i + 1] == "**" and i + 1 == len(parts) - 1:
                out.append(piece + r"(?:/[^/]+)*")
                break
            out.append(piece + follow)
    return "^" + "".join(out) + "$"


def in_directory(path: Column, directory: str) -> Column:
    directory = directory.rstrip("/")
    return (path == directory) | path.startswith(directory + "/")


def path_prefix(path: Column, prefix: str, like_compat: bool = False) -> Column:
    """Literal prefix; ``like_compat``: % and _ are wildcards and ASCII case doesn't count."""
    return path.ilike(prefix + "%") if like_compat else path.startswith(prefix)


def chunk_id(path: Column, digest: Column, start: Column, namespace: str = "6ba7b811-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """Name-based (version 5) identifier of a chunk."""
    name = F.concat_ws("\x00", path, digest, start.cast("string")).cast("binary")
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    third = F.concat(F.lit("5"), F.substring(h, 14, 3))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), third, F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))

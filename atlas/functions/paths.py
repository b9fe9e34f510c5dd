"""Names, paths, references and pages: pure column expressions.

Patterns run with ``(?d)`` (only ``\\n`` ends a line) where ``.`` matters and with ``(?U)`` where word
boundaries or blanks must follow Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier patterns of cloud links, in order of precedence.
FOLDER_ID = r"/folders/([a-zA-Z0-9_-]+)"
QUERY_ID = r"id=([a-zA-Z0-9_-]+)"
FILE_ID = r"/file/d/([a-zA-Z0-9_-]+)"
# One entry of a folder listing page (id, name), and a disposition header's file name.
LISTING_ENTRY = r'\["([a-zA-Z0-9_-]{25,})","([^"]+)"'
HEADER_NAME = r'filename="?([^";]+)"?'
DEFAULT_NAME = "downloaded_file.zip"
# Hosts that make a reference a link.
LINK_HOSTS = {"mediafire": "mediafire.com", "drive": "drive.google.com"}
# Pipeline version stamped into cache keys.
PIPELINE_VERSION = 6


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern``, null when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def content_hash(content: Column) -> Column:
    return F.md5(content)


def hash_key(digest: Column) -> Column:
    """The 12-character key files are named by."""
    return F.substring(digest, 1, 12)


def fingerprint(name: Column, size: Column, mtime: Column, version: int = PIPELINE_VERSION) -> Column:
    return F.concat_ws(
        "|", F.lit(f"v{version}"), name, size.cast("string"), F.unix_millis(mtime.cast("timestamp")).cast("string")
    )


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-case extension with its dot; empty for none, for dot files and for a trailing dot."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?s)^(.+)\.[^.]+$", "$1")


def parent_folder(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def clean_name(name: Column) -> Column:
    """Lower-case name without bracketed tags, which hold pack and artist names."""
    return F.lower(F.regexp_replace(name, r"(?d)[\[\(].*?[\]\)]", " "))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_reference(raw: Column) -> Column:
    """A pasted reference: the URL inside free text, or an unquoted, unescaped local path."""
    text = _strip(raw)
    quoted = (text.startswith("'") & text.endswith("'")) | (text.startswith('"') & text.endswith('"'))
    inner = F.when(quoted, _strip(F.regexp_replace(text, r"(?s)^.(.*).$|^.$", "$1"))).otherwise(text)
    local = F.replace(inner, F.lit("\\ "), F.lit(" "))
    lowered = F.lower(text)
    is_url = lowered.contains("http://") | lowered.contains("https://")
    return F.when(is_url, F.coalesce(_found(text, r"(?U)https?://\S+", 0), text)).otherwise(local)


def cloud_id(url: Column, folder: str = FOLDER_ID, query: str = QUERY_ID, file: str = FILE_ID) -> Column:
    """``struct(id, is_folder)``: folder pattern first, then the query id, then the file pattern."""
    by_folder, by_query, by_file = _found(url, folder), _found(url, query), _found(url, file)
    is_folder = F.when(by_folder.isNotNull(), F.lit(True)).when(
        by_query.isNotNull(), F.lower(url).contains("folder")
    ).otherwise(F.lit(False))
    return F.struct(F.coalesce(by_folder, by_query, by_file).alias("id"), is_folder.alias("is_folder"))


def ref_kind(ref: Column, hosts: dict[str, str] | None = None) -> Column:
    kind = F.lit("local")
    for name, host in reversed(list((hosts or LINK_HOSTS).items())):
        kind = F.when(F.lower(ref).contains(host), F.lit(name)).otherwise(kind)
    return kind


def extract_link(
    html: Column, button: str = "downloadButton", css: str = "download_link", needle: str = "download"
) -> Column:
    """Download link of a page: button id, then link inside a class, then href text, then bare text."""
    href = r"""(?i)\bhref\s*=\s*["']([^"']+)["']"""
    by_id = _found(html, rf"""(?is)<a\b[^>]*\bid\s*=\s*["']{button}["'][^>]*>""", 0)
    by_class = _found(
        html, rf"""(?is)\bclass\s*=\s*["'](?:[^"']*\s)?{css}(?:\s[^"']*)?["'][^>]*>.*?(<a\b[^>]*>)"""
    )
    by_href = _found(html, rf"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']*{needle}[^"']*)["']""")
    quoted = _found(html, rf'href="(https?://{needle}[^"]+)"')
    bare = _found(html, rf"""https?://{needle}[^'"]+""", 0)
    link = F.coalesce(_found(by_id, href), _found(by_class, href), by_href, quoted, bare)
    return _strip(F.replace(link, F.lit("&amp;"), F.lit("&")))


def extract_entries(html: Column, pattern: str = LISTING_ENTRY, own_id: Column | None = None) -> Column:
    """``array<struct(id, name)>`` of a listing page: without itself, first occurrence per id.

    The whole step happens inside the row, so one huge page costs no shuffle.
    """
    ids = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    names = F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
    first_seen = F.filter(
        F.arrays_zip(ids.alias("id"), names.alias("name"), F.sequence(F.lit(1), F.greatest(F.size(ids), F.lit(1))).alias("at")),
        lambda e: F.array_position(ids, e["id"]) == e["at"],
    )
    kept = first_seen if own_id is None else F.filter(first_seen, lambda e: e["id"] != own_id)
    return F.transform(kept, lambda e: F.struct(e["id"].alias("id"), _unescape(e["name"]).alias("name")))


def _unescape(name: Column) -> Column:
    """Decode backslash escapes the way a JSON string does; leave the name as it is otherwise."""
    decoded = F.get_json_object(F.concat(F.lit('{"s":"'), name, F.lit('"}')), "$.s")
    return F.when(name.contains("\\"), F.coalesce(decoded, name)).otherwise(name)


def url_basename(url: Column) -> Column:
    """Last segment of the URL's path, null when the path ends in a slash or is missing.

    Read off by pattern: a URL parser rejects the stray characters real links contain.
    """
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.nullif(F.regexp_replace(basename(path), ";.*$", ""), F.lit(""))


def file_name(header: Column, url: Column, default: str = DEFAULT_NAME) -> Column:
    """Percent-decoded name from a disposition header, else from the URL, else ``default``."""
    raw = F.coalesce(_found(header, HEADER_NAME), url_basename(url), F.lit(default))
    # A plus sign stays a plus sign: only form data uses it for a blank.
    return F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)

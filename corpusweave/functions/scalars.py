"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(text: Column) -> Column:
    """White space runs become one space; trimmed."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ +| +$", "")


def strip(text: Column) -> Column:
    """Trimmed of every Unicode white space."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def approx_tokens(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("long")


def byte_snippet(text: Column, n: int = 200) -> Column:
    """Trimmed; whole up to ``n`` bytes, else cut at a character's end within them, with an ellipsis."""
    t = strip(text)
    raw = F.encode(t, "UTF-8")
    # A byte 80..BF continues a character: step back until the next byte starts one.
    goes_on = lambda k: F.hex(F.substring(raw, k, 1)).between("80", "BF")
    size = F.when(~goes_on(n + 1), n).when(~goes_on(n), n - 1).when(~goes_on(n - 1), n - 2).otherwise(n - 3)
    return F.when(F.octet_length(t) <= n, t).otherwise(F.concat(F.decode(F.substring(raw, F.lit(1), size), "UTF-8"), F.lit("…")))


def char_snippet(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n), F.lit("…")))


def slug(text: Column) -> Column:
    """ASCII letters and digits lower-cased, other runs one dash, no dash at the ends; null if nothing is left."""
    out = F.lower(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    return F.nullif(out, F.lit(""))


def valid_url(url: Column) -> Column:
    """Trimmed, http or https, with a host."""
    return F.coalesce(strip(url).rlike(r"(?i)^https?://[^/?#\s:]+"), F.lit(False))


def url_id(url: Column) -> Column:
    """Slug of host and path, 60 characters at most, and six digits of the URL's hash."""
    u = strip(url)
    place = F.regexp_replace(F.regexp_replace(u, r"(?i)^https?://", ""), r"[?#].*$", "")
    base = F.regexp_replace(F.substring(F.coalesce(slug(place), F.lit("page")), 1, 60), "-+$", "")
    return F.concat(base, F.lit("-"), F.substring(F.sha2(u, 256), 1, 6))


def arxiv_id(text: Column) -> tuple[Column, Column]:
    """Id and version (``v`` and digits, or null) of an id or a URL that holds one; null if there is none."""
    pattern = r"^(?:(?i:arxiv:)|https?://(?:www\.|export\.)?arxiv\.org/(?:abs|pdf|html)/)?(\d{4}\.\d{4,5})(v\d+)?(?:\.pdf)?/?$"
    bare = F.regexp_replace(strip(text), r"[?#].*$|/+$", "")  # without query string, fragment and closing slashes
    found = lambda g: F.nullif(F.regexp_extract(bare, pattern, g), F.lit(""))
    return found(1), found(2)


def normal_title(text: Column) -> Column:
    """Lower-cased, without leading numbering, white space squeezed."""
    return squeeze(F.regexp_replace(F.lower(text), r"^\s*[0-9]+(\.[0-9]+)*\.?\s+", ""))


def deep_link(path: Column, page: Column, named: Column) -> Column:
    """A named destination beats a page."""
    return F.when(named.isNotNull(), F.concat(path, F.lit("#nameddest="), named)).when(
        page.isNotNull(), F.concat(path, F.lit("#page="), page.cast("string"))
    ).otherwise(path)


def json_object(text: Column, schema: str) -> Column:
    """The object between the first and the last brace of some prose."""
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)


def watch_query(kind: Column, value: Column) -> Column:
    """Query text of a standing interest; null for an unknown kind."""
    prefix = F.when(kind == "category", "cat:").when(kind == "author", "au:").when(kind == "query", "all:")
    return F.concat(prefix, value)


def title_of_file(name: Column) -> Column:
    return F.trim(F.translate(F.regexp_replace(name, r"\.[^.]*$", ""), "-_", "  "))


def html_comments_out(text: Column) -> Column:
    """Without comments; an open one runs to the end."""
    return F.regexp_replace(text, r"(?s)<!--.*?(-->|$)", "")


def is_reference_heading(heading: Column) -> Column:
    return F.lower(F.trim(heading)).rlike("^(reference|bibliography|acknowledg)")

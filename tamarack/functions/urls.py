"""Addresses as Columns: resolution of references, and the small forms in which addresses are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The five parts of an address (RFC 3986, appendix B).
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_NAMES = ("scheme", "authority", "path", "query", "fragment")


def _parts(url: Column) -> dict[str, Column]:
    """The parts; a part that is absent is null, not empty."""
    part = {n: F.regexp_extract(url, PARTS, k + 1) for k, n in enumerate(_NAMES)}
    rest = F.substring(url, F.when(part["scheme"] != "", F.length(part["scheme"]) + 2).otherwise(1), F.length(url))
    before = F.substring_index(url, "#", 1)
    return {
        "scheme": F.nullif(part["scheme"], F.lit("")), "authority": F.when(rest.startswith("//"), part["authority"]), "path": part["path"],
        "query": F.when(F.contains(before, F.lit("?")), part["query"]), "fragment": F.when(F.contains(url, F.lit("#")), part["fragment"]),
    }


def without_dots(path: Column) -> Column:
    """A path without its "." and ".." segments (section 5.2.4): each ".." takes the segment before it, but not the root."""
    given = F.split(path, "/")
    last = F.element_at(given, -1)
    segments = F.filter(F.when(last.isin(".", ".."), F.concat(given, F.array(F.lit("")))).otherwise(given), lambda s: s != ".")
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda done, s: F.when(s != "..", F.concat(done, F.array(s))).when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done))
    return F.when(F.contains(path, F.lit("/.")) | path.startswith("."), F.array_join(kept, "/")).otherwise(path)


def resolve_url(base: Column, href: Column) -> Column:
    """href as it reads on the page `base` (section 5.2). A reference with the base's own scheme and no authority is relative, as browsers take it. Null where href is; without a base, href as it is."""
    b, r = _parts(base), _parts(href)
    own = r["scheme"].isNotNull() & ~((F.lower(r["scheme"]) == F.lower(b["scheme"])) & r["authority"].isNull() & b["authority"].isNotNull())
    whole, root = own | r["authority"].isNotNull(), r["path"].startswith("/")
    merged = F.when(b["authority"].isNotNull() & (b["path"] == ""), F.concat(F.lit("/"), r["path"])).otherwise(F.concat(F.regexp_replace(b["path"], "[^/]*$", ""), r["path"]))
    path = F.when(whole & (r["authority"].isNotNull() | root), without_dots(r["path"])).when(whole, r["path"]).when(r["path"] == "", b["path"]).when(root, without_dots(r["path"])).otherwise(without_dots(merged))
    query = F.when(whole | (r["path"] != "") | r["query"].isNotNull(), r["query"]).otherwise(b["query"])
    scheme, authority = F.when(own, r["scheme"]).otherwise(b["scheme"]), F.when(whole, r["authority"]).otherwise(b["authority"])
    lead = lambda sign, part: F.coalesce(F.concat(F.lit(sign), part), F.lit(""))
    joined = F.concat(F.coalesce(F.concat(scheme, F.lit(":")), F.lit("")), lead("//", authority), path, lead("?", query), lead("#", r["fragment"]))
    return F.when(base.isNull(), href).otherwise(joined)


def same_url(a: Column, b: Column) -> Column:
    """Whether two addresses are the same but for slashes at their ends."""
    return F.regexp_replace(a, "/+$", "") == F.regexp_replace(b, "/+$", "")


def url_path(url: Column) -> Column:
    """The path of an absolute address, "/" if it has none; empty for what is no address."""
    return F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.coalesce(F.nullif(_parts(url)["path"], F.lit("")), F.lit("/"))).otherwise("")


def clean_url(url: Column) -> Column:
    """An address without its query and fragment."""
    return F.regexp_replace(url, "[?#].*$", "")

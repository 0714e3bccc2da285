"""Scalar text rules as Spark expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query parameters that carry no identity.
TRACKING = ["ref", "referrer", "source", "fbclid", "gclid", "mc_cid", "mc_eid", "igshid", "spm", "scm", "from", "share_source"]
# Markers of blocked pages.
BLOCKED = ["enable javascript", "sign in to continue", "access denied", "verify you are human"]
# Kinds of credentials and their patterns.
CREDENTIALS = {
    "private_key": r"(?i)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "authorization_header": r"(?i)\bAuthorization\s*:\s*Bearer\s+\S+",
    "openai_style_key": r"\bsk-[A-Za-z0-9_-]{20,}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    "aws_access_key": r"\bAKIA[0-9A-Z]{16}\b",
}
WORD = r"[\p{L}\p{N}_]+"
CJK = r"[一-鿿]"


def canonical_url(url: Column) -> Column:
    """Lower-case host without user or default port, no fragment, trailing slash or tracking parameter; parameters
    decoded, sorted by name and value, and encoded again. Null for what is no http(s) URL with a host."""
    url = F.trim(url)
    scheme = F.regexp_extract(url, r"^(https?)://", 1)
    place = F.regexp_replace(F.regexp_extract(url, r"^https?://([^/?#]*)", 1), r"^.*@", "")
    host = F.lower(place)
    host = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).otherwise(F.regexp_replace(host, r":443$", ""))
    path = F.regexp_replace(F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1), r"/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    decoded = lambda s: F.coalesce(F.try_url_decode(s), s)
    encoded = lambda s: F.replace(F.replace(F.url_encode(s), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(decoded(F.regexp_extract(p, r"^([^=]*)", 1)).alias("k"), decoded(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(TRACKING) & ~F.lower(p["k"]).startswith("utm_")))
    joined = F.array_join(F.transform(kept, lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")
    return F.when((scheme != "") & (F.regexp_replace(host, r":\d*$", "") != ""), F.concat(scheme, F.lit("://"), host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")))


def content_hash(text: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")), 256)


def estimated_tokens(text: Column) -> Column:
    """int(cjk / 1.5 + others / 4), at least 1 unless empty."""
    rest = F.length(F.regexp_replace(text, CJK, ""))
    found = F.floor((F.length(text) - rest) / 1.5 + rest / 4)
    return F.when(F.length(text) > 0, F.greatest(found, F.lit(1))).otherwise(0).cast("long")


def cjk_bigrams(text: Column) -> Column:
    """Distinct pairs of neighbours in runs of at least two CJK characters."""
    runs = F.regexp_extract_all(text, F.lit(f"({CJK}{{2,}})"), 1)
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda k: F.substring(r, k, 2)))))


def search_tokens(text: Column) -> Column:
    """Distinct words in lower case and bigrams of CJK runs."""
    lowered = F.lower(text)
    return F.array_union(F.regexp_extract_all(lowered, F.lit(f"({WORD})"), 1), cjk_bigrams(lowered))


@F.arrow_udf(T.StringType())
def _nfkc(title: pa.Array) -> pa.Array:
    # Arrow's own normalisation leaves what it has taken apart uncomposed
    return pa.array([t if t is None else unicodedata.normalize("NFKC", t) for t in title.to_pylist()], pa.string())


def folded_title(title: Column) -> Column:
    """A title in lower case with compatibility forms (full width, ligatures, circled numbers) replaced by what
    they stand for, without blanks around it; null is empty. Titles in ASCII have no such forms and are not sent to Python
    but as nulls."""
    wide = F.when(F.octet_length(title) > F.length(title), title)
    return F.trim(F.lower(F.coalesce(_nfkc(wide), title, F.lit(""))))


def title_tokens(title: Column, stop: list[str]) -> Column:
    """Words of two and more Latin letters or digits, the parts of compound ones that aren't numbers, pairs of
    CJK characters; without those that say nothing. The title is in lower case, full-width forms folded."""
    none = F.array().cast("array<string>")
    words = F.regexp_extract_all(title, F.lit(r"[a-z0-9][a-z0-9.\-_]*"), F.lit(0))
    told = lambda w: (F.length(w) > 1) & ~w.isin(stop)
    split = lambda w: F.filter(F.split(w, r"[.\-_]+"), lambda p: F.length(p) > 1)
    parts = F.flatten(F.transform(words, lambda w: F.when(F.size(split(w)) > 1, F.filter(split(w), lambda p: told(p) & ~F.regexp_like(p, F.lit("^[0-9]+$")))).otherwise(none)))
    return F.array_union(F.array_union(F.filter(words, told), parts), F.filter(cjk_bigrams(title), lambda w: ~w.isin(stop)))


def fulltext_gate(body: Column, title: Column, url: Column, published: Column, source: Column, links: Column, release: Column) -> Column:
    """EMPTY_BODY, BLOCKED_PAGE, ... or ACCEPTED, in the order of the rules."""
    text = F.trim(body)
    chars = F.length(text)
    paragraphs = F.size(F.filter(F.split(text, r"\n"), lambda p: F.length(F.trim(p)) >= 40))
    present = sum(F.when(F.length(F.coalesce(c.cast("string"), F.lit(""))) > 0, 1).otherwise(0) for c in (title, url, published, source))
    lowered = F.lower(text)
    blocked = F.lit(False)
    for marker in BLOCKED:
        blocked = blocked | lowered.contains(marker)
    return (
        F.when(F.coalesce(chars, F.lit(0)) == 0, "EMPTY_BODY")
        .when(blocked, "BLOCKED_PAGE")
        .when(chars < F.when(release, 80).otherwise(300), "BODY_TOO_SHORT")
        .when(~release & (paragraphs < 2), "TOO_FEW_PARAGRAPHS")
        .when(~release & (links / chars > 0.35), "LINK_DENSITY")
        .when(present < 3, "INSUFFICIENT_METADATA")
        .otherwise("ACCEPTED")
    )


def credential_labels(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in CREDENTIALS.items()]))


def head_tail(text: Column, most: int = 6000, marker: str = "\n...\n") -> Column:
    head = int(most * 0.65)
    tail = most - head
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(marker), F.substring(text, -tail, tail)))


def canonical_question(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def overlap(a: Column, b: Column) -> Column:
    """Shared share of the smaller set; of the union where that has under three."""
    shared, least = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).when(least < 3, shared / F.size(F.array_union(a, b))).otherwise(shared / least)


# Relative dates and what listings append to a title; titles that say nothing.
AGO = r"(?:about\s+|almost\s+|over\s+)?\d+\s+(?:second|minute|hour|day|week|month|year)s?\s+ago"
LISTING = rf"\s+\S+\s*[•·]\s*(?:{AGO}|[A-Z][a-z]{{2}}\s+\d{{1,2}},\s+\d{{4}})(?:\s*[•·]\s*\d+)?\s*$"
EMPTY_TITLES = ["read more", "read the blog", "read blog", "learn more", "continue reading", "see more", "view more", "更多", "阅读全文", "查看详情"]


def usable_title(title: Column) -> Column:
    text = F.trim(title)
    bare = F.trim(F.lower(text), F.lit(" .·•"))
    return F.coalesce((F.length(text) >= 4) & ~F.regexp_like(text, F.lit(r"(?i)^https?://\S+$")) & ~bare.isin(EMPTY_TITLES), F.lit(False))


def title_of_body(body: Column) -> Column:
    """The first heading or line outside fences and front matter that can be a title, at most 200 characters;
    one walk over the lines with the state of fence and front matter."""
    lines = F.transform(F.split(body, r"\r?\n"), lambda s: F.trim(s))
    start = F.struct(F.lit(False).alias("fence"), (F.get(lines, F.lit(0)) == "---").alias("front"), F.lit(True).alias("first"), F.lit(None).cast("string").alias("title"))

    def step(state: Column, line: Column) -> Column:
        mark, close = line.startswith("```"), state["front"] & ~state["first"] & (line == "---")
        found = F.trim(F.regexp_replace(line, r"^#{1,3}\s+", ""))
        plain = ~F.regexp_like(found, F.lit(r"^(?:---|```|\||>|!|<)")) & ~F.regexp_like(found, F.lit(r"^[a-z_][a-z0-9_-]*:\s"))
        taken = state["title"].isNull() & ~mark & ~close & ~state["fence"] & ~state["front"] & (line != "") & plain & usable_title(found)
        return F.struct(
            F.when(mark, ~state["fence"]).otherwise(state["fence"]).alias("fence"), (state["front"] & ~close).alias("front"), F.lit(False).alias("first"), F.when(taken, F.trim(F.substring(found, 1, 200))).otherwise(state["title"]).alias("title")
        )

    return F.aggregate(lines, start, step)["title"]


def clean_title(title: Column, body: Column, fallback: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(title, LISTING, ""), rf"\s*[•·]?\s*{AGO}\s*$", "")
    cleaned = F.trim(cleaned, F.lit(" \t·•-—|"))
    return F.when(usable_title(cleaned), cleaned).otherwise(F.coalesce(title_of_body(body), fallback))

"""Near duplicates, passages and stories: pairs, clusters, their products, and the daily choice from them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import scores
from corpusloom.functions.text import cjk_bigrams, folded_title, title_tokens
from corpusloom.operators import alike, chunks, graph, near
from corpusloom.plans.registry import query
from corpusloom.plans.scoring import _HEAT, _HEAT_SQL, scored
from corpusloom.sources.tables import NOW, SQL, items, passages, read_tables, sources

#: Latin letters as CJK characters: the test tables hold none
LATIN, WIDE = "abcdefghijklmnopqrstuvwxyz", "一丁七万丈三上下不与丐丑专且世丘丙业丛东丝丞丢两严并"


@query(f"""SELECT doc_id, CAST(len(b) AS BIGINT) AS n, md5(array_to_string(list_sort(b), ' ')) AS digest FROM (SELECT doc_id, coalesce(list_distinct(flatten(list_transform(regexp_extract_all(translate(lower(text), '{LATIN}', '{WIDE}'), '[一-鿿]{{2,}}'),
  lambda r: list_transform(range(1, length(r)), lambda k: substr(r, k, 2))))), []) AS b FROM documents)""")
def g4_cjk_bigrams(spark, sf_dir):
    """Distinct pairs of neighbours in runs of CJK characters, of texts whose Latin letters are made such characters."""
    (docs,) = read_tables(spark, sf_dir, "documents")
    found = docs.select("doc_id", cjk_bigrams(F.translate(F.lower("text"), LATIN, WIDE)).alias("b"))
    return found.select("doc_id", F.size("b").cast("bigint").alias("n"), F.md5(F.array_join(F.array_sort("b"), " ")).alias("digest"))


@query()
def g3_simhash64(spark, sf_dir):
    (docs,) = read_tables(spark, sf_dir, "documents")
    return docs.select("doc_id", near.simhash64("text").alias("simhash"))


@query()
def g2_chunk_document(spark, sf_dir):
    """Passages of every document, with a heading before each tenth line, as the test texts have none."""
    (docs,) = read_tables(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda s, k: F.concat(F.when(k % 10 == 0, F.concat(F.lit("## Part "), (k / 10 + 1).cast("int").cast("string"), F.lit("\n\n"))).otherwise(""), s))
    return chunks.chunk_documents(docs.select("doc_id", F.array_join(lines, "\n\n").alias("text")))


def prints(spark, sf_dir):
    rows = items(spark, sf_dir)
    return rows.select(F.col("item_id").alias("id"), F.col("observed_at").alias("at"), near.simhash64("body").alias("simhash"))


@query()
def c9_near_duplicates(spark, sf_dir):
    """Pairs of bursts of equal fingerprints that differ in at most three bits and 14 days somewhere, and which items a burst holds (bits 0)."""
    rounds = graph.Rounds(spark, "near")
    copies = rounds.save(near.copies_of(prints(spark, sf_dir)), "copies")
    members = copies.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(0).alias("bits"))
    return near.near_pairs(copies).unionByName(members)


def canonical_items(spark, sf_dir):
    """id, canonical of every item with a fingerprint: itself, or the kept item that it nearly repeats."""
    rounds = graph.Rounds(spark, "near")
    copies = rounds.save(near.copies_of(prints(spark, sf_dir)), "copies")
    return near.assigned(copies, rounds.save(near.near_pairs(copies), "pairs"), rounds)


@query()
def i2_near_dup_assign(spark, sf_dir):
    found = canonical_items(spark, sf_dir)
    return found.select(F.col("id").alias("item_id"), F.col("canonical").alias("canonical_id"), F.when(F.col("id") != F.col("canonical"), "NEAR").alias("kind"))


# ---- passages in their documents

_TOKENS = "greatest(1, length(passage) // 4)"
_SECTION = "CASE WHEN ordinal % 7 < 5 THEN 'section ' || (ordinal // 7) ELSE '' END"
_TIERS = f"""{SQL}, c AS (SELECT item_id, ordinal, {_TOKENS} AS tokens, {_SECTION} AS section FROM passage), t AS (SELECT *, sum(tokens) OVER (PARTITION BY item_id) AS whole, sum(tokens) OVER (PARTITION BY item_id, section) AS part FROM c),
k AS (SELECT *, CASE WHEN whole <= 300 THEN 'document' WHEN section <> '' AND part <= 300 THEN 'section' ELSE 'neighbours' END AS tier FROM t)"""
BUDGET, CAP = 300, 390  # of the short test passages; 2,000 and 2,600 by default


def tiered(spark, sf_dir, budget: int = 2000):
    """Passages with their tokens, section and the granularity that fits a budget: document, section or neighbours."""
    rows = passages(spark, sf_dir)
    section = F.when(F.col("ordinal") % 7 < 5, F.concat(F.lit("section "), F.floor(F.col("ordinal") / 7).cast("string"))).otherwise("")
    rows = rows.select("item_id", "ordinal", "passage", F.greatest(F.lit(1), F.floor(F.length("passage") / 4)).alias("tokens"), section.alias("section"))
    parts = rows.groupBy("item_id", "section").agg(F.sum("tokens").alias("part"))
    wholes = parts.groupBy("item_id").agg(F.sum("part").alias("whole"))
    tier = F.when(F.col("whole") <= budget, "document").when((F.col("section") != "") & (F.col("part") <= budget), "section").otherwise("neighbours")
    return rows.join(parts, ["item_id", "section"]).join(wholes, "item_id").withColumn("tier", tier)


@query(f"WITH {_TIERS} SELECT tier, count(*) AS passages FROM k GROUP BY tier")
def d17_tier_distribution(spark, sf_dir):
    return tiered(spark, sf_dir, BUDGET).groupBy("tier").agg(F.count("*").alias("passages"))


@query(f"""WITH {_TIERS}, hit AS (SELECT * FROM k WHERE ordinal % 5 = 1), r AS (SELECT h.item_id, h.ordinal, h.tier, o.ordinal AS other, o.tokens FROM hit h JOIN k o ON o.item_id = h.item_id AND (h.tier = 'document' OR (h.tier = 'section' AND o.section = h.section) OR (h.tier = 'neighbours' AND abs(o.ordinal - h.ordinal) <= 1))),
n AS (SELECT *, sum(tokens) OVER b AS near, sum(tokens) FILTER (WHERE other >= ordinal) OVER b AS behind FROM r WINDOW b AS (PARTITION BY item_id, ordinal))
SELECT item_id, ordinal, tier, sum(tokens) AS tokens, string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) AS parts FROM n WHERE tier <> 'neighbours' OR other = ordinal OR near <= {CAP} OR (other > ordinal AND behind <= {CAP}) GROUP BY ALL""")
def h14_parent_block(spark, sf_dir):
    """The largest block around a hit (every fifth passage) that fits: document, section, or the hit and its
    neighbours; of those the one before goes first where they are too large, then the one behind."""
    rows = tiered(spark, sf_dir, BUDGET)
    hits = rows.filter("ordinal % 5 = 1").select("item_id", F.col("ordinal").alias("hit"), F.col("section").alias("hit_section"), F.col("tier").alias("hit_tier"))
    all_ = hits.filter("hit_tier = 'document'").join(rows, "item_id")
    part = hits.filter("hit_tier = 'section'").join(rows, (hits.item_id == rows.item_id) & (F.col("hit_section") == F.col("section"))).drop(rows.item_id)
    beside = hits.filter("hit_tier = 'neighbours'").withColumn("ordinal", F.explode(F.array(F.col("hit") - 1, F.col("hit"), F.col("hit") + 1))).join(rows, ["item_id", "ordinal"])
    own = W.partitionBy("item_id", "hit")
    beside = beside.withColumns({"near": F.sum("tokens").over(own), "behind": F.sum(F.when(F.col("ordinal") >= F.col("hit"), F.col("tokens"))).over(own)})
    beside = beside.filter((F.col("ordinal") == F.col("hit")) | (F.col("near") <= CAP) | ((F.col("ordinal") > F.col("hit")) & (F.col("behind") <= CAP)))
    names = ["item_id", "hit", "hit_tier", "ordinal", "tokens"]
    both = all_.select(*names).union(part.select(*names)).union(beside.select(*names))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list("ordinal")), lambda o: o.cast("string")), ",")
    return both.groupBy("item_id", "hit", "hit_tier").agg(F.sum("tokens").alias("tokens"), parts.alias("parts")).withColumnsRenamed({"hit": "ordinal", "hit_tier": "tier"})


# ---- stories

STOP = ["release", "releases", "update", "updates", "new", "the", "and", "for", "with", "ai"]
_STOP = "['" + "', '".join(STOP) + "']"
_TITLE = "lower(title) || CASE item_id % 4 WHEN 0 THEN ' v1.' || (item_id % 3) WHEN 1 THEN ' alpha-beta' ELSE '' END"
_WORDS = f"""list_distinct(list_concat(list_filter(w, lambda x: length(x) > 1 AND NOT list_contains({_STOP}, x)), flatten(list_transform(w, lambda x: CASE WHEN len(list_filter(regexp_split_to_array(x, '[._-]+'), lambda p: length(p) > 1)) > 1
  THEN list_filter(regexp_split_to_array(x, '[._-]+'), lambda p: length(p) > 1 AND NOT list_contains({_STOP}, p) AND NOT regexp_matches(p, '^[0-9]+$')) ELSE [] END))))"""
_MEMBERS = f"""m AS (SELECT item_id, source_id, content_type, observed_at AS at, list_distinct(regexp_extract_all(title, '[A-Z][a-z]+')) AS entities, CASE WHEN item_id % 3 > 0 THEN list_distinct([content_type, 't' || (item_id % 5)]) ELSE [] END AS topics,
  CASE WHEN item_id % 4 = 0 THEN ['1.' || (item_id % 3)] ELSE [] END AS versions, {_WORDS} AS tokens FROM (SELECT *, regexp_extract_all({_TITLE}, '[a-z0-9][a-z0-9._-]*') AS w FROM item))"""


@query(f"WITH {SQL}, {_MEMBERS} SELECT item_id, array_to_string(list_sort(tokens), ' ') AS tokens FROM m")
def g6_title_tokens(spark, sf_dir):
    return members(spark, sf_dir).select("item_id", F.array_join(F.array_sort("tokens"), " ").alias("tokens"))


#: printable ASCII but the blank, and the same in full width
_NARROW = "".join(map(chr, range(33, 127)))
_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in _NARROW)


@query(f"WITH {SQL} SELECT item_id, array_to_string(list_sort({_WORDS}), ' ') AS tokens FROM (SELECT item_id, regexp_extract_all(lower(title), '[a-z0-9][a-z0-9._-]*') AS w FROM item)")
def g6_wide_titles(spark, sf_dir):
    """Tokens of titles of which every second is written in full width: they are those of the plain titles."""
    title = F.when(F.col("item_id") % 2 == 1, F.translate("title", _NARROW, _WIDE)).otherwise(F.col("title"))
    return items(spark, sf_dir).select("item_id", F.array_join(F.array_sort(title_tokens(folded_title(title), STOP)), " ").alias("tokens"))


def members(spark, sf_dir):
    """Items with the sets that stories are made from."""
    k = F.col("item_id")
    title = F.concat(folded_title(F.col("title")), F.when(k % 4 == 0, F.concat(F.lit(" v1."), (k % 3).cast("string"))).when(k % 4 == 1, " alpha-beta").otherwise(""))
    none = F.array().cast("array<string>")
    return items(spark, sf_dir).select(
        "item_id", "source_id", "content_type", "quality", F.col("observed_at").alias("at"), F.array_distinct(F.regexp_extract_all("title", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("entities"),
        F.when(k % 3 > 0, F.array_distinct(F.array(F.col("content_type"), F.concat(F.lit("t"), (k % 5).cast("string"))))).otherwise(none).alias("topics"),
        F.when(k % 4 == 0, F.array(F.concat(F.lit("1."), (k % 3).cast("string")))).otherwise(none).alias("versions"), title_tokens(title, STOP).alias("tokens"),
    )


MERGE, SUGGEST, HOURS = 0.52, 0.42, 72
ANNOUNCED = ["model_release", "product_release", "api_update"]


def story_pairs(rows):
    """a, b (a < b), total, veto, hours of the pairs that reach ``SUGGEST``."""
    veto = F.when(F.col("versions"), "version_conflict").when(F.col("sources"), "same_source")
    return alike.pairs(rows, ANNOUNCED, SUGGEST).select("a", "b", F.round("total", 6).alias("total"), veto.alias("veto"), "hours").filter(F.col("total") >= SUGGEST)


def _overlap(a: str, b: str) -> str:
    return f"(CASE WHEN least(len({a}), len({b})) = 0 THEN 0e0 WHEN least(len({a}), len({b})) < 3 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE len(list_intersect({a}, {b})) / least(len({a}), len({b})) END)"


_KIND = "('" + "', '".join(ANNOUNCED) + "')"
_PARTS = f"""0.35 * {_overlap("x.tokens", "y.tokens")} + 0.25 * {_overlap("x.entities", "y.entities")} + 0.15 * CASE WHEN len(list_intersect(x.entities, y.entities)) = 0 THEN 0e0 ELSE len(list_intersect(x.entities, y.entities)) / least(len(x.entities), len(y.entities)) * CASE WHEN (x.content_type IN {_KIND}) = (y.content_type IN {_KIND}) THEN 1 ELSE 0.6 END END
  + 0.1 * greatest(0, 1 - abs(epoch(x.at) - epoch(y.at)) / 259200e0)"""
_PAIRS = f"""pair AS (SELECT x.item_id AS a, y.item_id AS b, round(CASE WHEN len(x.topics) > 0 AND len(y.topics) > 0 THEN ({_PARTS} + 0.05 * {_overlap("x.topics", "y.topics")}) / 0.9 ELSE ({_PARTS}) / 0.85 END, 6) AS total,
  CASE WHEN len(x.versions) > 0 AND len(y.versions) > 0 AND len(list_intersect(x.versions, y.versions)) = 0 THEN 'version_conflict' WHEN x.source_id = y.source_id THEN 'same_source' END AS veto FROM m x JOIN m y ON x.item_id < y.item_id)"""


@query(f"WITH {SQL}, {_MEMBERS}, {_PAIRS} SELECT a, b, total, veto FROM pair WHERE total >= {SUGGEST}")
def c10_story_pairs(spark, sf_dir):
    return story_pairs(graph.Rounds(spark, "stories").save(members(spark, sf_dir), "members")).drop("hours")


def newest_first(rows):
    """node, place of items: the newest first, those without a time last."""
    time = F.coalesce(-F.col("at").cast("timestamp").cast("double"), F.lit(float("inf")))
    return rows.select(F.col("item_id").alias("node"), F.struct(time.alias("t"), F.col("item_id").alias("id")).alias("place"))


def clustered(rows, rounds):
    """item_id, story (its newest item's id): newest first, an item joins the first story all of whose members it
    matches without a veto, if one of them lies within 72 hours; else it begins one."""
    pairs = rounds.save(story_pairs(rows), "pairs")
    return cliques_of(rows, pairs, rounds)


def cliques_of(rows, pairs, rounds):
    links = pairs.filter((F.col("total") >= MERGE) & F.col("veto").isNull()).select("a", "b", F.coalesce(F.col("hours") < HOURS, F.lit(True)).alias("near"))
    return graph.greedy_cliques(newest_first(rows), links, rounds).withColumnRenamed("node", "item_id")


def suggestions(rows, pairs, stories):
    """story, item_id, total: items that a story had nearly taken when they were looked at, before the one that they are in:
    their weakest pair with its members till then reaches ``SUGGEST``, but not ``MERGE``, and none has a veto."""
    place = newest_first(rows).join(stories.withColumnRenamed("item_id", "node"), "node")
    side = lambda c: place.select(F.col("node").alias(c), F.col("place.t").alias(f"t{c}"), F.col("story").alias(f"s{c}"))
    near = F.coalesce(F.col("hours") < HOURS, F.lit(True))
    both = pairs.filter("veto is null").select("a", "b", "total", near.alias("near")).join(side("a"), "a").join(side("b"), "b").filter("sa <> sb")
    turned = F.expr("ta > tb or (ta = tb and a > b)")  # b comes before a
    later = lambda x, y: F.when(turned, F.col(x)).otherwise(F.col(y))
    before = both.select(later("a", "b").alias("a"), later("sa", "sb").alias("own"), later("sb", "sa").alias("story"), "total", "near").groupBy("a", "own", "story").agg(
        F.count("*").alias("known"), F.min("total").alias("total"), F.max("near").alias("near")
    )
    before = before.filter((F.col("total") < MERGE) & F.col("near")).join(place.select(F.col("node").alias("a"), F.col("place").alias("pa")), "a")
    members = place.select("story", F.col("place").alias("pm"))  # few of a story: no two of one source
    sizes = before.join(members, "story").filter("pm < pa").groupBy("a", "own", "story", "known", "total").agg(F.count("*").alias("size"))
    first = lambda c: place.filter("node = story").select(F.col("node").alias(c), F.col("place").alias(f"p_{c}"))
    found = sizes.filter("known = size").join(first("story"), "story").join(first("own"), "own").filter("p_story < p_own")
    return found.select("story", F.col("a").alias("item_id"), "total")


@query()
def i3_story_cluster(spark, sf_dir):
    rounds = graph.Rounds(spark, "stories")
    return clustered(rounds.save(members(spark, sf_dir), "members"), rounds)


@query()
def i3_story_suggestions(spark, sf_dir):
    rounds = graph.Rounds(spark, "stories")
    rows = rounds.save(members(spark, sf_dir), "members")
    pairs = rounds.save(story_pairs(rows), "pairs")
    return suggestions(rows, pairs, rounds.save(cliques_of(rows, pairs, rounds), "stories"))


_RANK = "CASE tier WHEN 'primary' THEN 0 WHEN 'secondary' THEN 2 WHEN 'expert' THEN 3 ELSE 4 END"
_FIVE = f"""{SQL}, s AS (SELECT i.*, i.item_id // 5 AS story, s.tier, s.organization, ({_RANK}, CASE WHEN content_type IN {_KIND} THEN 0 ELSE 1 END, -coalesce(quality, 0), item_id) AS first FROM item i JOIN source s USING (source_id))"""


def story_products(rows):
    """story, primary_id, items, outlets, occurred and heat of members (story, item_id, tier, organization, source_id,
    content_type, quality, published_at): its first source is official before announced before good."""
    rank = F.coalesce(F.create_map(*[F.lit(v) for p in (("primary", 0), ("secondary", 2), ("expert", 3)) for v in p])[F.col("tier")], F.lit(4))
    first = F.struct(rank.alias("r"), F.when(F.col("content_type").isin(ANNOUNCED), 0).otherwise(1).alias("k"), (-F.coalesce("quality", F.lit(0.0))).alias("q"), "item_id", "tier", "content_type")
    good = F.when(F.coalesce("quality", F.lit(0.0)) == 0, 50.0).otherwise(F.col("quality"))
    found = rows.groupBy("story").agg(
        F.min(first).alias("f"), F.count("*").alias("items"), F.countDistinct(F.coalesce("organization", "source_id")).alias("outlets"), F.min("published_at").cast("timestamp").alias("occurred"), F.max(good).alias("good")
    )
    age = F.coalesce(scores.hours_before(F.lit(NOW), F.col("occurred")), F.lit(0.0))
    return found.select("story", F.col("f.item_id").alias("primary_id"), "items", "outlets", "occurred", scores.heat(age, F.col("f.tier"), F.col("f.content_type"), F.col("good"), F.col("outlets")).alias("heat"))


@query(f"""WITH {_FIVE}, g AS (SELECT story, min(first) AS f, count(*) AS items, count(DISTINCT coalesce(organization, source_id)) AS outlets, min(published_at) AS occurred, max(coalesce(nullif(quality, 0), 50e0)) AS good FROM s GROUP BY story)
SELECT g.story, p.item_id AS primary_id, g.items, g.outlets, strftime(g.occurred, '%Y-%m-%d') AS occurred, round(round(pow(0.5e0, greatest(coalesce(epoch(TIMESTAMP '{NOW}') - epoch(g.occurred), 0), 0) / 3600 / 18) * {_HEAT.replace("content_type", "p.content_type")} * (CASE p.tier WHEN 'primary' THEN 30e0 WHEN 'expert' THEN 18 WHEN 'secondary' THEN 12 ELSE 6 END
  + 20 * ln(1 + g.outlets - 1) + 0.15e0 * g.good), 3), 1) AS heat FROM g JOIN s p ON p.first = g.f""")
def i4_story_products(spark, sf_dir):
    """Products of stories of five neighbouring items."""
    rows = items(spark, sf_dir).join(F.broadcast(sources(spark, sf_dir).select("source_id", "tier", "organization")), "source_id").withColumn("story", F.floor(F.col("item_id") / 5))
    found = story_products(rows)
    return found.withColumns({"occurred": F.date_format("occurred", "yyyy-MM-dd"), "heat": F.round("heat", 1)})


@query(f"""WITH {_FIVE}, g AS (SELECT story, min(first) AS f, count(DISTINCT coalesce(organization, source_id)) AS outlets, min(published_at) AS occurred, max(coalesce(nullif(quality, 0), 50e0)) AS good FROM s WHERE item_id % 6 > 0 GROUP BY story),
h AS (SELECT g.story, g.outlets, round(round(pow(0.5e0, greatest(coalesce(epoch(TIMESTAMP '{NOW}') - epoch(g.occurred), 0), 0) / 3600 / 18) * {_HEAT.replace("content_type", "p.content_type")} * (CASE p.tier WHEN 'primary' THEN 30e0 WHEN 'expert' THEN 18 WHEN 'secondary' THEN 12 ELSE 6 END + 20 * ln(g.outlets) + 0.15e0 * g.good), 3), 1) AS heat FROM g JOIN s p ON p.first = g.f)
SELECT item_id, CASE WHEN item_id % 6 > 0 THEN heat END AS heat, CASE WHEN item_id % 6 > 0 THEN outlets ELSE 1 END AS source_count FROM s LEFT JOIN h USING (story)""")
def i6_sync_item_heat(spark, sf_dir):
    """Members take their story's heat and number of sources; items outside (here: every sixth) keep none, and one."""
    rows = items(spark, sf_dir).join(F.broadcast(sources(spark, sf_dir).select("source_id", "tier", "organization")), "source_id").withColumn("story", F.floor(F.col("item_id") / 5))
    inside = F.col("item_id") % 6 > 0
    heat = story_products(rows.filter(inside)).select("story", F.round("heat", 1).alias("story_heat"), "outlets")
    return rows.select("item_id", "story").join(heat, "story", "left").select("item_id", F.when(inside, F.col("story_heat")).alias("heat"), F.when(inside, F.col("outlets")).otherwise(1).cast("long").alias("source_count"))


@query(f"""WITH {SQL}, old AS (SELECT item_id, item_id // 5 AS story, item_id // 5 % 3 = 0 AS locked FROM item WHERE item_id % 11 > 0), new AS (SELECT item_id, item_id // 4 AS story FROM item)
SELECT item_id, 'old-' || story AS story FROM old WHERE locked UNION ALL SELECT item_id, 'new-' || story FROM new WHERE item_id NOT IN (SELECT item_id FROM old WHERE locked)""")
def i5_exclude_locked(spark, sf_dir):
    """Locked stories keep their members; all other items are clustered anew."""
    rows, k = items(spark, sf_dir).select("item_id"), F.col("item_id")
    locked = rows.filter((k % 11 > 0) & (F.floor(k / 5) % 3 == 0)).select("item_id", F.concat(F.lit("old-"), F.floor(k / 5).cast("string")).alias("story"))
    fresh = rows.join(locked.select("item_id"), "item_id", "left_anti").select("item_id", F.concat(F.lit("new-"), F.floor(k / 4).cast("string")).alias("story"))
    return locked.union(fresh)


@query(f"""WITH {SQL}, src AS (SELECT item_id // 5 AS story, count(DISTINCT source_id) AS n FROM item GROUP BY 1), dup AS (SELECT item_id // 7 * 7 AS item_id, count(*) AS n FROM item WHERE item_id % 7 > 4 GROUP BY 1)
SELECT i.item_id, greatest(coalesce(src.n, 1), 1 + coalesce(dup.n, 0)) AS outlets, round(round(pow(0.5e0, greatest(epoch(TIMESTAMP '2024-01-02') - epoch(coalesce(published_at, observed_at)), 0) / 3600 / 18) * {_HEAT} * (CASE tier WHEN 'primary' THEN 30e0 WHEN 'expert' THEN 18 WHEN 'secondary' THEN 12 ELSE 6 END
  + 20 * ln(greatest(coalesce(src.n, 1), 1 + coalesce(dup.n, 0))) + 0.15e0 * coalesce(nullif(quality, 0), 50)), 3), 1) AS heat FROM item i JOIN source USING (source_id) LEFT JOIN src ON src.story = i.item_id // 5 LEFT JOIN dup ON dup.item_id = i.item_id
  WHERE coalesce(published_at, observed_at) > TIMESTAMP '2024-01-02' - INTERVAL 7 DAY""")
def i7_rescore_heat(spark, sf_dir):
    """Heat of a week's items by how many outlets have the story, or how many copies there are (binding: of each seven items the last two)."""
    rows, k, now = items(spark, sf_dir), F.col("item_id"), "2024-01-02"
    outlets = rows.groupBy(F.floor(k / 5).alias("story")).agg(F.countDistinct("source_id").alias("n"))
    copies = rows.filter(k % 7 > 4).groupBy((F.floor(k / 7) * 7).alias("item_id")).agg(F.count("*").alias("copies"))
    at = F.coalesce("published_at", "observed_at").cast("timestamp")
    recent = rows.withColumns({"story": F.floor(k / 5), "at": at}).filter(F.col("at") > F.lit(now).cast("timestamp") - F.expr("INTERVAL 7 DAY"))
    recent = recent.join(F.broadcast(sources(spark, sf_dir).select("source_id", "tier")), "source_id").join(outlets, "story", "left").join(copies, "item_id", "left")
    n = F.greatest(F.coalesce("n", F.lit(1)), 1 + F.coalesce("copies", F.lit(0)))
    heat = scores.heat(scores.hours_before(F.lit(now), F.col("at")), F.col("tier"), F.col("content_type"), F.col("quality"), n)
    return recent.select("item_id", n.alias("outlets"), F.round(heat, 1).alias("heat"))


# ---- the daily choice

QUOTA, PER_FAMILY, RESEARCH = 12, 3, 4


def chosen_daily(rows):
    """day, item_id, position of rows (day, item_id, family, content_type, score): by score, at most twelve a day, three of a
    family of sources and four of research. A family's fourth of either kind can't be taken, whatever the others are, so at
    most three of each go to a day's group."""
    kind = W.partitionBy("day", "family", F.col("content_type") == "research").orderBy(F.desc("score"), "item_id")
    few = rows.withColumn("r", F.row_number().over(kind)).filter(F.col("r") <= PER_FAMILY).select("day", "item_id", "family", "content_type", "score")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        out, families, research = [], {}, 0
        for r in group.sort_values(["score", "item_id"], ascending=[False, True]).itertuples():
            if len(out) == QUOTA:
                break
            if families.get(r.family, 0) < PER_FAMILY and (r.content_type != "research" or research < RESEARCH):
                families[r.family] = families.get(r.family, 0) + 1
                research += r.content_type == "research"
                out.append((r.day, r.item_id, len(out) + 1))
        return pd.DataFrame(out, columns=["day", "item_id", "position"])

    return few.groupBy("day").applyInPandas(choose, "day string, item_id long, position long")


def families(rows):
    """Sources whose number ends in 0 to 4 are one family (as feeds of one archive are)."""
    return rows.withColumn("family", F.when(F.col("n") % 10 < 5, "archive").otherwise(F.col("source_id")))


@query()
def i8_select_for_days(spark, sf_dir):
    rows = families(scored(spark, sf_dir))
    return chosen_daily(rows.select("day", "item_id", "family", "content_type", "score")).join(rows.select("item_id", "source_id", "score"), "item_id")


_CHOSEN = f"""{SQL}, {_HEAT_SQL}, pick AS (SELECT day, item_id, source_id, content_type, title, score, item_id // 5 AS story FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, item_id) AS r FROM scored) WHERE r <= 12)"""
_WEEK = "isoyear(CAST(day AS DATE)) || '-W' || lpad(CAST(week(CAST(day AS DATE)) AS VARCHAR), 2, '0')"
SECTIONS = ["model_release", "product_release", "api_update", "open_source", "research", "security", "business", "policy", "tutorial", "opinion"]
_PLACE = "CASE content_type " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(SECTIONS)) + f" ELSE {len(SECTIONS)} END"


@query(f"""WITH {_CHOSEN}, e AS (SELECT 'daily' AS period, day AS key, p.* FROM pick p UNION ALL SELECT 'weekly', {_WEEK}, p.* FROM pick p UNION ALL SELECT 'monthly', substr(day, 1, 7), p.* FROM pick p),
c AS (SELECT *, row_number() OVER (PARTITION BY period, key, story ORDER BY score DESC, item_id) AS r FROM e), o AS (SELECT period, key, story, count(DISTINCT source_id) AS outlets FROM e GROUP BY ALL)
SELECT period, key, count(*) AS items, count(DISTINCT {_PLACE}) AS sections, CASE WHEN count(*) < CASE period WHEN 'monthly' THEN 10 ELSE 5 END THEN 'REVIEW_REQUIRED' ELSE 'PUBLISHED' END AS status,
  md5(string_agg('- ' || title || ' · ' || source_id || CASE WHEN outlets > 1 THEN ' · +' || (outlets - 1) ELSE '' END, chr(10) ORDER BY {_PLACE}, score DESC, item_id)) AS body_digest FROM c JOIN o USING (period, key, story) WHERE r = 1 GROUP BY period, key""")
def i9_build_report(spark, sf_dir):
    """Reports by day, ISO week and month from the daily choice: one entry a story, its best, with how many other
    outlets have it; entries in the order of the sections; published with enough of them."""
    best = F.row_number().over(W.partitionBy("day").orderBy(F.desc("score"), "item_id"))
    pick = scored(spark, sf_dir).withColumn("r", best).filter(F.col("r") <= QUOTA).select("day", "item_id", "source_id", "content_type", "title", "score", F.floor(F.col("item_id") / 5).alias("story"))
    date = F.col("day").cast("date")
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), date).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))
    periods = F.array(*[F.struct(F.lit(p).alias("period"), k.alias("key")) for p, k in (("daily", F.col("day")), ("weekly", week), ("monthly", F.substring("day", 1, 7)))])
    rows = pick.select("*", F.explode(periods).alias("p")).select("*", "p.period", "p.key")
    place = F.coalesce(F.create_map(*[F.lit(v) for k, s in enumerate(SECTIONS) for v in (s, k)])[F.col("content_type")], F.lit(len(SECTIONS)))
    top = F.max_by(F.struct("item_id", "title", "source_id", "score", place.alias("place")), F.struct("score", -F.col("item_id"))).alias("e")
    stories = rows.groupBy("period", "key", "story").agg(top, F.countDistinct("source_id").alias("outlets")).select("period", "key", "e.*", "outlets")
    entry = F.concat(F.lit("- "), "title", F.lit(" · "), "source_id", F.when(F.col("outlets") > 1, F.concat(F.lit(" · +"), (F.col("outlets") - 1).cast("string"))).otherwise(""))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", (-F.col("score")).alias("s"), "item_id", entry.alias("entry")))), lambda s: s["entry"])
    found = stories.groupBy("period", "key").agg(F.count("*").alias("items"), F.countDistinct("place").alias("sections"), F.md5(F.array_join(lines, "\n")).alias("body_digest"))
    enough = F.col("items") >= F.when(F.col("period") == "monthly", 10).otherwise(5)
    return found.select("period", "key", "items", "sections", F.when(enough, "PUBLISHED").otherwise("REVIEW_REQUIRED").alias("status"), "body_digest")


@query(f"""WITH {SQL}, {_HEAT_SQL}, newest AS (SELECT day, max(observed_at) AS newest FROM scored GROUP BY day), rep AS (SELECT day, min(observed_at) + INTERVAL 20 HOUR AS generated FROM scored WHERE item_id % 3 > 0 GROUP BY day)
SELECT day, generated IS NULL OR newest > generated AS stale FROM newest LEFT JOIN rep USING (day)""")
def i10_stale_reports(spark, sf_dir):
    """Days whose report is missing or older than their newest item."""
    rows = scored(spark, sf_dir).select("day", F.col("observed_at").cast("timestamp").alias("at"), "item_id")
    newest = rows.groupBy("day").agg(F.max("at").alias("newest"))
    made = rows.filter("item_id % 3 > 0").groupBy("day").agg((F.min("at") + F.expr("INTERVAL 20 HOUR")).alias("generated"))
    return newest.join(made, "day", "left").select("day", (F.col("generated").isNull() | (F.col("newest") > F.col("generated"))).alias("stale"))


@query()
def i11_pipeline_run(spark, sf_dir):
    """From items to reports: near duplicates go, passages are cut, stories found, heat and scores follow, days chosen, and each
    day's report counted."""
    rounds = graph.Rounds(spark, "run")
    kept = rounds.save(canonical_items(spark, sf_dir).filter("id = canonical").select(F.col("id").alias("item_id")), "kept")
    rows = rounds.save(members(spark, sf_dir).join(kept, "item_id", "left_semi"), "members")
    stories = rounds.save(clustered(rows, rounds), "stories")
    (docs,) = read_tables(spark, sf_dir, "documents")
    sizes = chunks.chunk_documents(docs.withColumnRenamed("doc_id", "item_id").join(kept, "item_id", "left_semi"), "item_id").groupBy("item_id").agg(F.count("*").alias("passages"))
    every = scored(spark, sf_dir).drop("heat").join(stories, "item_id").join(sizes, "item_id", "left")
    heat = story_products(every).select("story", F.col("heat"), "outlets")
    every = families(every.join(heat, "story"))
    days = chosen_daily(every.select("day", "item_id", "family", "content_type", "score"))
    facts = every.select("item_id", "story", "heat", "outlets", F.coalesce("passages", F.lit(0)).alias("passages"))
    found = days.join(facts, "item_id").groupBy("day").agg(F.count("*").alias("items"), F.countDistinct("story").alias("stories"), F.round(F.max("heat"), 3).alias("heat"), F.max("outlets").alias("outlets"), F.sum("passages").alias("passages"))
    return found.withColumn("status", F.when(F.col("items") >= 5, "PUBLISHED").otherwise("REVIEW_REQUIRED"))

"""Plans of questions, and the citations of answers: their markers, claims, support and audit."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import questions as Q
from corpusloom.plans.evaluation import _SPARSE, sparse
from corpusloom.plans.registry import query
from corpusloom.sources.tables import ANSWER_SQL, QUESTION_SQL, ZONE, answers, questions, read_tables

_TYPE = Q.first_match_sql("question", Q.QUESTION_TYPES, "explainer")
_KIND = f"coalesce({Q.first_match_sql('question', Q.WINDOWS, None)}, CASE WHEN {_TYPE} = 'recent_updates' THEN 'default' END)"
_PLAN = f"""{QUESTION_SQL}, p AS (SELECT *, {_TYPE} AS question_type, {_KIND} AS kind, timezone('{ZONE}', timezone('UTC', asked_at)) AS now FROM question),
planned AS (SELECT *, CASE kind WHEN 'today' THEN date_trunc('day', now) WHEN 'yesterday' THEN date_trunc('day', now) - INTERVAL 1 DAY WHEN 'last_week' THEN date_trunc('week', now) - INTERVAL 7 DAY
  WHEN 'this_week' THEN date_trunc('week', now) WHEN 'last_month' THEN date_trunc('month', now) - INTERVAL 1 MONTH WHEN 'this_month' THEN date_trunc('month', now)
  WHEN 'weeks' THEN now - to_days(7 * CAST(nullif(regexp_extract(question, '{dict(Q.WINDOWS)["weeks"]}', 1), '') AS INTEGER)) WHEN 'days' THEN now - to_days(CAST(nullif(regexp_extract(question, '{dict(Q.WINDOWS)["days"]}', 1), '') AS INTEGER))
  WHEN 'recent' THEN now - INTERVAL {Q.RECENT_DAYS} DAY WHEN 'default' THEN now - INTERVAL {Q.UNSPECIFIED_DAYS} DAY END AS begin_at,
  CASE kind WHEN 'today' THEN date_trunc('day', now) + INTERVAL 1 DAY WHEN 'yesterday' THEN date_trunc('day', now) WHEN 'last_week' THEN date_trunc('week', now) WHEN 'this_week' THEN date_trunc('week', now) + INTERVAL 7 DAY
  WHEN 'last_month' THEN date_trunc('month', now) WHEN 'this_month' THEN date_trunc('month', now) + INTERVAL 1 MONTH ELSE CASE WHEN kind IS NOT NULL THEN now END END AS end_at FROM p)"""


def planned(spark, sf_dir):
    """The questions with type, kind of window and its bounds."""
    asked, text = questions(spark, sf_dir), F.col("question")
    rows = asked.withColumns({"question_type": Q.question_type(text), "kind": Q.window_kind(text)})
    begin, end = Q.window_bounds(text, F.col("kind"), F.col("asked_at"))
    return rows.withColumns({"begin_at": begin, "end_at": end})


@query(f"WITH {QUESTION_SQL} SELECT conv_id, turn, {_TYPE} AS question_type FROM question")
def g13_classify_question(spark, sf_dir):
    return questions(spark, sf_dir).select("conv_id", "turn", Q.question_type(F.col("question")).alias("question_type"))


@query(f"WITH {QUESTION_SQL} SELECT conv_id, turn, CASE WHEN {_TYPE} IN ('comparison', 'recent_updates') THEN 20 ELSE 40 END AS depth FROM question")
def h7_route_depth(spark, sf_dir):
    kind = g13_classify_question(spark, sf_dir)
    return kind.select("conv_id", "turn", F.when(F.col("question_type").isin("comparison", "recent_updates"), 20).otherwise(40).alias("depth"))


@query(f"""WITH {_PLAN} SELECT conv_id, turn, kind, strftime(begin_at, '%Y-%m-%d %H:%M:%S') AS begin_at, strftime(end_at, '%Y-%m-%d %H:%M:%S') AS end_at,
  coalesce(kind NOT IN ('recent', 'default'), false) AS explicit, question_type IN ('recent_updates', 'timeline') AS freshness FROM planned""")
def g14_resolve_time_window(spark, sf_dir):
    """The window of each question in local time, half open; whether it was given, and whether freshness matters."""
    say = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    explicit = F.coalesce(~F.col("kind").isin("recent", "default"), F.lit(False))
    return planned(spark, sf_dir).select("conv_id", "turn", "kind", say("begin_at"), say("end_at"), explicit.alias("explicit"), F.col("question_type").isin("recent_updates", "timeline").alias("freshness"))


@query(f"""WITH {_PLAN} SELECT conv_id, turn, strftime(coalesce(begin_at, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS begin_at,
  strftime(least(coalesce(end_at, now), now), '%Y-%m-%d %H:%M:%S') AS end_at FROM planned""")
def j18_snapshot_window(spark, sf_dir):
    """Windows that end at the time of asking at the latest; an open one begins with the epoch."""
    now = F.from_utc_timestamp("asked_at", ZONE)
    say = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    begin, end = F.coalesce("begin_at", F.lit("1970-01-01").cast("timestamp")), F.least(F.coalesce("end_at", now), now)
    return planned(spark, sf_dir).select("conv_id", "turn", say(begin).alias("begin_at"), say(end).alias("end_at"))


_OTHER = _TYPE.replace("question,", "text,")


@query(f"WITH {_PLAN}, two AS (SELECT conv_id, turn, question_type AS one, {_OTHER} AS other, kind IS NOT NULL AS one_window, {_KIND.replace('question,', 'text,')} IS NOT NULL AS other_window FROM planned) SELECT * FROM two WHERE one <> other OR one_window <> other_window")
def j17_planner_disagreement(spark, sf_dir):
    """Where the plan of a whole question and that of its words alone differ in type, or in having a window."""
    text = F.col("text")
    rows = planned(spark, sf_dir).select("conv_id", "turn", F.col("question_type").alias("one"), Q.question_type(text).alias("other"), F.col("kind").isNotNull().alias("one_window"), Q.window_kind(text).isNotNull().alias("other_window"))
    return rows.filter("one <> other or one_window <> other_window")


@query(f"""WITH {_PLAN} SELECT count(*) AS questions, count(expected_window) AS with_window, round(avg(CASE WHEN question_type = expected_type THEN 1e0 ELSE 0e0 END), 6) AS type_accuracy,
  round(avg(CASE WHEN kind IS NOT DISTINCT FROM expected_window THEN 1e0 ELSE 0e0 END), 6) AS window_accuracy, round(count(expected_window) / count(*), 6) AS coverage FROM planned""")
def j11_planner_accuracy(spark, sf_dir):
    share = lambda hit: F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 6)
    return planned(spark, sf_dir).agg(
        F.count("*").alias("questions"), F.count("expected_window").alias("with_window"), share(F.col("question_type") == F.col("expected_type")).alias("type_accuracy"),
        share(F.col("kind").eqNullSafe(F.col("expected_window"))).alias("window_accuracy"), F.round(F.count("expected_window") / F.count("*"), 6).alias("coverage"),
    )


_NAMES = "name AS (SELECT DISTINCT regexp_extract(text, '^([A-Za-z]{3,})', 1) AS name FROM documents WHERE regexp_matches(text, '^[A-Za-z]{3,}'))"
_NAMED = """hit AS (SELECT DISTINCT q.query_id, n.name FROM (SELECT item_id AS query_id, lower(text) AS t FROM benchmark) q JOIN name n ON regexp_matches(q.t, '(^|[^a-z0-9])' || lower(n.name) || '($|[^a-z0-9])'))"""


def resolved(asked, names):
    """query_id, name of (query_id, text): names of Latin letters that stand apart in a text. A text's
    distinct words are joined to the names' first words; whole names are verified after that."""
    runs = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    keyed = names.select("name", F.get(runs(F.col("name")), F.lit(0)).alias("word"))
    words = asked.select("query_id", F.lower("text").alias("text"), F.explode(F.array_distinct(runs(F.col("text")))).alias("word"))
    pattern = F.concat(F.lit(r"(^|[^a-z0-9])\Q"), F.lower("name"), F.lit(r"\E($|[^a-z0-9])"))
    return words.join(keyed, "word").filter(F.regexp_like("text", pattern)).select("query_id", "name").distinct()


@query(f"WITH {_NAMES}, {_NAMED} SELECT query_id, name FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit o WHERE o.query_id = h.query_id AND length(o.name) > length(h.name) AND contains(lower(o.name), lower(h.name)))")
def c6_resolve_entities(spark, sf_dir):
    """Names found in questions, without those inside a longer name found there."""
    docs, items = read_tables(spark, sf_dir, "documents", "benchmark")
    names = docs.filter(F.col("text").rlike("^[A-Za-z]{3,}")).select(F.regexp_extract("text", "^([A-Za-z]{3,})", 1).alias("name")).distinct()
    found = resolved(items.select(F.col("item_id").alias("query_id"), "text"), names)
    longer = found.select(F.col("query_id").alias("q"), F.col("name").alias("other"))
    inside = (F.col("query_id") == F.col("q")) & (F.length("other") > F.length("name")) & F.lower("other").contains(F.lower("name"))
    return found.join(longer, inside, "left_anti")


_ABOUT = " OR ".join(f"regexp_matches(question, '{p}')" for p in Q.ABOUT_COLLECTION)


@query(f"WITH {QUESTION_SQL}, n AS (SELECT DISTINCT source AS name FROM documents) SELECT conv_id, turn, ({_ABOUT}) AND NOT EXISTS (SELECT 1 FROM n WHERE regexp_matches(lower(question), '(^|[^a-z0-9])' || name || '($|[^a-z0-9])')) AS about_collection FROM question")
def g22_metadata_question(spark, sf_dir):
    """Questions about the collection itself: by wording, and without the name of a source."""
    docs, asked = read_tables(spark, sf_dir, "documents")[0], questions(spark, sf_dir)
    keyed = asked.select(F.struct("conv_id", "turn").alias("query_id"), F.col("question").alias("text"))
    named = resolved(keyed, docs.select(F.col("source").alias("name")).distinct()).select("query_id.conv_id", "query_id.turn").distinct().withColumn("named", F.lit(True))
    rows = asked.join(named, ["conv_id", "turn"], "left")
    return rows.select("conv_id", "turn", (Q.about_collection(F.col("question")) & F.col("named").isNull()).alias("about_collection"))


# ---- citations

_SEGMENT, _MARK = r"[^。！？!?\n]+(?:[。！？!?]+|$)", r"\[E([0-9]+)\]"
#: the same for Java, whose search else begins again at every character of a line that ends without a mark
_WHOLE = r"(?:^|(?<=[。！？!?\n]))[^。！？!?\n]++(?:[。！？!?]++|\z)"
_SEGMENTS = f"""{ANSWER_SQL}, seg AS (SELECT conv_id, turn, unnest(s) AS segment, unnest(range(len(s))) AS place FROM (SELECT conv_id, turn, regexp_extract_all(answer, '{_SEGMENT}') AS s FROM answer)),
claim AS (SELECT conv_id, turn, place, regexp_extract_all(segment, '{_MARK}', 1) AS numbers, trim(regexp_replace(trim(regexp_replace(regexp_replace(segment, '{_MARK}', '', 'g'), '\\s+', ' ', 'g'), ' 、,，'), '\\s+([。！？!?；;，,])', '\\1', 'g')) AS claim FROM seg),
mark AS (SELECT conv_id, turn, place, claim, CAST(unnest(numbers) AS BIGINT) AS number FROM claim WHERE claim <> ''),
cited AS (SELECT conv_id, turn, number, min_by(claim, (length(claim), place)) AS claim FROM mark GROUP BY ALL)"""


def claims(spark, sf_dir):
    """conv_id, turn, number, claim: of each marker the shortest segment that bears it, without markers."""
    split = F.regexp_extract_all("answer", F.lit(_WHOLE), F.lit(0))
    rows = answers(spark, sf_dir).select("conv_id", "turn", F.posexplode(split).alias("place", "segment")).filter(F.col("segment").contains("[E"))
    bare = F.trim(F.regexp_replace(F.regexp_replace("segment", _MARK, ""), r"\s+", " "))
    bare = F.regexp_replace(F.trim(bare, F.lit(" 、,，")), r"\s+([。！？!?；;，,])", "$1")
    rows = rows.select("conv_id", "turn", "place", F.trim(bare).alias("claim"), F.regexp_extract_all("segment", F.lit(_MARK), F.lit(1)).alias("numbers")).filter("claim <> ''")
    marks = rows.select("conv_id", "turn", "place", "claim", F.explode(F.col("numbers").cast("array<bigint>")).alias("number"))
    return marks.groupBy("conv_id", "turn", "number").agg(F.min_by("claim", F.struct(F.length("claim"), "place")).alias("claim"))


@query(f"WITH {_SEGMENTS} SELECT conv_id, turn, number, claim FROM cited")
def g20_extract_citations(spark, sf_dir):
    return claims(spark, sf_dir)


_VALUE = r"(?:[$￥¥]\s*)?\d+(?:[.,]\d+)*(?:\s*(?:%|％|倍|美元|元|万亿|亿|万))?"
_RELATION = "%|％|倍|便宜|昂贵|成本|高于|低于|超过|少于|多于|相当|持平|差距|节省|提升|下降|增长|减少"
_CURRENCY = r"[$￥¥]\s*\d+(?:[.,]\d+)*"
_PRICED = "text || CASE turn % 4 WHEN 0 THEN ' 成本 $' || length(text) || ' 对 $3.5，即 64%' WHEN 1 THEN ' 提升 ' || turn || '倍 [E3]' WHEN 2 THEN ' 高于 5 与 7' ELSE '' END"


@query(f"""SELECT conv_id, turn, len(regexp_extract_all(regexp_replace(a, '\\[(?:E)?\\d+\\]', '', 'g'), '{_VALUE}')) >= 2 AND regexp_matches(regexp_replace(a, '\\[(?:E)?\\d+\\]', '', 'g'), '{_RELATION}') AS needs_audit,
  len(list_filter(regexp_split_to_array(a, '[。！？!?\\n]'), lambda s: regexp_matches(s, '%|％') AND len(regexp_extract_all(s, '{_CURRENCY}')) >= 2)) > 0 AS mixes_units FROM (SELECT conv_id, turn, {_PRICED} AS a FROM conversations)""")
def g21_numeric_relation_flags(spark, sf_dir):
    """Answers with two numbers and a word that relates them, and those with a percentage beside two prices in one sentence.

    Numbers are appended to the turns, which hold few."""
    (talk,) = read_tables(spark, sf_dir, "conversations")
    form = F.col("turn") % 4
    more = F.when(form == 0, F.concat(F.lit(" 成本 $"), F.length("text").cast("string"), F.lit(" 对 $3.5，即 64%"))).when(form == 1, F.concat(F.lit(" 提升 "), F.col("turn").cast("string"), F.lit("倍 [E3]"))).when(form == 2, " 高于 5 与 7").otherwise("")
    rows = talk.select("conv_id", "turn", F.concat("text", more).alias("a"))
    prose = F.regexp_replace("a", r"\[(?:E)?\d+\]", "")
    mixed = F.exists(F.split("a", r"[。！？!?\n]"), lambda s: F.regexp_like(s, F.lit("%|％")) & (F.size(F.regexp_extract_all(s, F.lit(_CURRENCY), F.lit(0))) >= 2))
    audit = (F.size(F.regexp_extract_all(prose, F.lit(_VALUE), F.lit(0))) >= 2) & F.regexp_like(prose, F.lit(_RELATION))
    return rows.select("conv_id", "turn", audit.alias("needs_audit"), mixed.alias("mixes_units"))


#: evidence of a turn: passages 1 to 3 + turn mod 3, each a document
_EVIDENCE = "SELECT conv_id, turn, unnest(range(1, 4 + turn % 3)) AS number FROM conversations WHERE role = 'assistant'"


def evidence(spark, sf_dir):
    (talk,) = read_tables(spark, sf_dir, "conversations")
    return talk.filter("role = 'assistant'").select("conv_id", "turn", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("turn") % 3 + 3)).alias("number"))


_MARKS = f"{ANSWER_SQL}, m AS (SELECT conv_id, turn, CAST(unnest(n) AS BIGINT) AS number, unnest(range(len(n))) AS place FROM (SELECT conv_id, turn, regexp_extract_all(answer, '{_MARK}', 1) AS n FROM answer)), e AS ({_EVIDENCE}), f AS (SELECT conv_id, turn, number, min(place) AS first FROM m GROUP BY ALL)"


@query(f"""WITH {_MARKS}, bound AS (SELECT f.*, row_number() OVER (PARTITION BY conv_id, turn ORDER BY first) AS renumbered FROM f JOIN e USING (conv_id, turn, number)),
s AS (SELECT conv_id, turn, len(list_filter(x, lambda s: trim(s) <> '')) AS sentences, len(list_filter(x, lambda s: trim(s) <> '' AND len(list_intersect(list_transform(regexp_extract_all(s, '{_MARK}', 1), lambda n: CAST(n AS BIGINT)), range(1, 4 + turn % 3))) = 0)) AS uncited
  FROM (SELECT conv_id, turn, regexp_extract_all(answer, '[^。！？.\\n]+[。！？.]?') AS x FROM answer))
SELECT s.conv_id, s.turn, coalesce(b.bound, 0) AS bound, coalesce(b.order_, '') AS order_, coalesce(u.unknown, 0) AS unknown, s.uncited, s.sentences, CASE WHEN coalesce(b.bound, 0) = 0 THEN 'no_citation' WHEN s.uncited = s.sentences THEN 'empty' END AS violation FROM s
LEFT JOIN (SELECT conv_id, turn, count(*) AS bound, string_agg(number || '>' || renumbered, ',' ORDER BY renumbered) AS order_ FROM bound GROUP BY ALL) b USING (conv_id, turn)
LEFT JOIN (SELECT conv_id, turn, count(*) AS unknown FROM f ANTI JOIN e USING (conv_id, turn, number) GROUP BY ALL) u USING (conv_id, turn)""")
def h17_citation_audit(spark, sf_dir):
    """Each answer's markers bound to its evidence and renumbered in reading order, markers without
    evidence, sentences without a bound marker (they are dropped), and what then forbids publication."""
    stored = answers(spark, sf_dir)
    marks = stored.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("answer", F.lit(_MARK), F.lit(1))).alias("place", "number"))
    first = marks.groupBy("conv_id", "turn", F.col("number").cast("bigint").alias("number")).agg(F.min("place").alias("first"))
    known = evidence(spark, sf_dir)
    bound = first.join(known, ["conv_id", "turn", "number"]).withColumn("renumbered", F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("first")))
    entries = F.array_sort(F.collect_list(F.struct("renumbered", F.concat_ws(">", F.col("number").cast("string"), F.col("renumbered").cast("string")).alias("entry"))))
    bound = bound.groupBy("conv_id", "turn").agg(F.count("*").alias("bound"), F.array_join(F.transform(entries, lambda s: s["entry"]), ",").alias("order_"))
    unknown = first.join(known, ["conv_id", "turn", "number"], "left_anti").groupBy("conv_id", "turn").agg(F.count("*").alias("unknown"))
    real = F.filter(F.regexp_extract_all("answer", F.lit(r"[^。！？.\n]+[。！？.]?"), F.lit(0)), lambda s: F.trim(s) != "")
    most = F.col("turn") % 3 + 3
    bare = F.filter(real, lambda s: ~F.exists(F.regexp_extract_all(s, F.lit(_MARK), F.lit(1)), lambda n: n.cast("bigint").between(1, most)))
    rows = stored.select("conv_id", "turn", F.size(real).cast("bigint").alias("sentences"), F.size(bare).cast("bigint").alias("uncited")).join(bound, ["conv_id", "turn"], "left").join(unknown, ["conv_id", "turn"], "left")
    n = F.coalesce("bound", F.lit(0))
    return rows.select(
        "conv_id", "turn", n.alias("bound"), F.coalesce("order_", F.lit("")).alias("order_"), F.coalesce("unknown", F.lit(0)).alias("unknown"), "uncited", "sentences",
        F.when(n == 0, "no_citation").when(F.col("uncited") == F.col("sentences"), "empty").alias("violation"),
    )


_SCORED = f"support AS (SELECT query_id, doc_id, rank, CASE WHEN quality IS NULL THEN NULL ELSE round(0.2e0 + 0.5e0 * quality * score / max(score) OVER (PARTITION BY query_id), 6) END AS support FROM (SELECT s.*, l.quality FROM sparse s LEFT JOIN labels l USING (doc_id) WHERE rank <= 8))"


def supported(spark, sf_dir):
    """The eight best candidates of a question with a support score: from labels; null without one."""
    (labels,) = read_tables(spark, sf_dir, "labels")
    rows = sparse(spark, sf_dir).filter("rank <= 8").join(labels.select("doc_id", "quality"), "doc_id", "left")
    best = F.max("score").over(W.partitionBy("query_id"))
    return rows.select("query_id", "doc_id", "rank", F.when(F.col("quality").isNotNull(), F.round(0.2 + 0.5 * F.col("quality") * F.col("score") / best, 6)).alias("support"))


SUPPORT, WEAK = 0.30, 0.5


@query(f"""WITH {_SPARSE}, {_SCORED}, w AS (SELECT *, coalesce(support < {SUPPORT}, false) AS weak, bool_and(coalesce(support < {SUPPORT}, false)) OVER q AS all_weak, row_number() OVER (PARTITION BY query_id ORDER BY support DESC NULLS LAST, rank) AS best FROM support WINDOW q AS (PARTITION BY query_id)),
k AS (SELECT query_id, count(*) FILTER (WHERE weak AND NOT (all_weak AND best = 1)) AS dropped, count(*) AS n, count(support) AS scored, round(avg(support), 4) AS mean, round(min(support), 4) AS least, round(avg(CASE WHEN support >= {SUPPORT} THEN 1e0 WHEN support IS NOT NULL THEN 0e0 END), 4) AS share FROM w GROUP BY query_id)
SELECT query_id, dropped, n - dropped AS kept, scored, mean, least, share, dropped / n >= {WEAK} OR (n - dropped <= 1 AND dropped > 0) AS weak_retrieval FROM k""")
def h18_support_gate(spark, sf_dir):
    """Citations under the threshold go, but never all of a question's; those without a score stay."""
    own = W.partitionBy("query_id")
    weak = F.coalesce(F.col("support") < SUPPORT, F.lit(False))
    rows = supported(spark, sf_dir).withColumns({"weak": weak, "all_weak": F.bool_and(weak).over(own), "best": F.row_number().over(own.orderBy(F.desc_nulls_last("support"), "rank"))})
    gone = F.count_if(F.col("weak") & ~(F.col("all_weak") & (F.col("best") == 1)))
    share = F.avg(F.when(F.col("support") >= SUPPORT, 1.0).when(F.col("support").isNotNull(), 0.0))
    found = rows.groupBy("query_id").agg(gone.alias("dropped"), F.count("*").alias("n"), F.count("support").alias("scored"), F.round(F.avg("support"), 4).alias("mean"), F.round(F.min("support"), 4).alias("least"), F.round(share, 4).alias("share"))
    kept = F.col("n") - F.col("dropped")
    weak = (F.col("dropped") / F.col("n") >= WEAK) | ((kept <= 1) & (F.col("dropped") > 0))
    return found.select("query_id", "dropped", kept.alias("kept"), "scored", "mean", "least", "share", weak.alias("weak_retrieval"))


@query(f"""WITH {_SPARSE} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS number, doc_id, CASE WHEN length(text) > 1200 THEN substr(text, 1, 1200) ELSE text END AS passage,
  'story-' || (doc_id // 5) AS story, (SELECT count(DISTINCT source) FROM documents o WHERE o.doc_id // 5 = d.doc_id // 5) AS outlets FROM sparse JOIN documents d USING (doc_id) WHERE length(trim(text)) > 0 QUALIFY number <= 10""")
def h21_load_evidence(spark, sf_dir):
    """Passages of the best candidates numbered in the order of their ranks, at most 1,200 characters each
    (the evidence's size), with their story and how many sources it has."""
    (docs,) = read_tables(spark, sf_dir, "documents")
    stories = docs.groupBy(F.floor(F.col("doc_id") / 5).alias("story_no")).agg(F.countDistinct("source").alias("outlets"))
    texts = docs.filter(F.length(F.trim("text")) > 0).select("doc_id", F.substring("text", 1, 1200).alias("passage"), F.floor(F.col("doc_id") / 5).alias("story_no"))
    rows = sparse(spark, sf_dir).select("query_id", "doc_id", "rank").join(texts, "doc_id")
    rows = rows.withColumn("number", F.row_number().over(W.partitionBy("query_id").orderBy("rank")).cast("bigint")).filter("number <= 10")
    return rows.join(stories, "story_no").select("query_id", "number", "doc_id", "passage", F.concat(F.lit("story-"), F.col("story_no").cast("string")).alias("story"), "outlets")


@query(f"""WITH {_SPARSE} SELECT query_id, b.text AS question, string_agg(DISTINCT split_part(d.text, '.', 1), '|' ORDER BY split_part(d.text, '.', 1)) AS titles,
  coalesce(string_agg(DISTINCT nullif(regexp_extract(d.text, '^([A-Z][a-z]+)', 1), ''), '|' ORDER BY nullif(regexp_extract(d.text, '^([A-Z][a-z]+)', 1), '')), '') AS subjects
  FROM sparse JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE rank <= 10 GROUP BY query_id, b.text""")
def h20_followup_context(spark, sf_dir):
    """What a follow-up is made from: the question, the distinct titles cited and their subjects."""
    docs, items = read_tables(spark, sf_dir, "documents", "benchmark")
    facts = docs.select("doc_id", F.split_part("text", F.lit("."), F.lit(1)).alias("title"), F.nullif(F.regexp_extract("text", "^([A-Z][a-z]+)", 1), F.lit("")).alias("subject"))
    rows = sparse(spark, sf_dir).filter("rank <= 10").select("query_id", "doc_id").join(facts, "doc_id")
    found = rows.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("title")), "|").alias("titles"), F.array_join(F.sort_array(F.collect_set("subject")), "|").alias("subjects"))
    return found.join(items.select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), "query_id").select("query_id", "question", "titles", "subjects")


_DONE = f"""WITH {_MARKS}, doc AS (SELECT conv_id, turn, answer, turn % 4 <> 3 AS answerable, length(answer) < 120 AS refused FROM answer),
c AS (SELECT conv_id, turn, count(*) AS cited, count(*) FILTER (WHERE (conv_id + number) % 3 = 0) AS relevant FROM f JOIN e USING (conv_id, turn, number) GROUP BY ALL),
s AS (SELECT conv_id, turn, len(x) AS sentences, len(list_filter(x, lambda s: regexp_matches(s, '{_MARK}'))) AS with_mark FROM (SELECT conv_id, turn, list_filter(regexp_extract_all(answer, '[^。！？.\\n]+[。！？.]?'), lambda s: trim(s) <> '') AS x FROM answer)),
r AS (SELECT answerable, refused, with_mark / nullif(sentences, 0) AS coverage, relevant / cited AS prec, coalesce(cited, 0) AS citations, contains(answer, 'the') AS must FROM doc JOIN s USING (conv_id, turn) LEFT JOIN c USING (conv_id, turn))"""


@query(f"""{_DONE} SELECT count(*) AS questions, count(*) FILTER (WHERE answerable) AS answerable, count(*) FILTER (WHERE answerable AND NOT refused) AS answered, round(avg(coverage) FILTER (WHERE answerable AND NOT refused), 4) AS citation_coverage,
  round(avg(prec) FILTER (WHERE answerable AND NOT refused), 4) AS citation_precision, round(avg(citations) FILTER (WHERE answerable AND NOT refused), 2) AS avg_citations, round(avg(CASE WHEN must THEN 1e0 ELSE 0e0 END) FILTER (WHERE answerable), 4) AS must_contain,
  round(count(*) FILTER (WHERE refused AND NOT answerable) / count(*) FILTER (WHERE NOT answerable), 4) AS refusal_rate, round(count(*) FILTER (WHERE refused AND answerable) / count(*) FILTER (WHERE answerable), 4) AS over_refusal_rate FROM r""")
def j10_generation_metrics(spark, sf_dir):
    """Coverage and precision of citations, required words, refusals: over answers (binding: every fourth turn
    is unanswerable, short answers are refusals, a third of the evidence is relevant)."""
    stored, known = answers(spark, sf_dir), evidence(spark, sf_dir)
    marks = stored.select("conv_id", "turn", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(_MARK), F.lit(1))).cast("array<bigint>")).alias("number"))
    cited = marks.join(known, ["conv_id", "turn", "number"]).groupBy("conv_id", "turn").agg(F.count("*").alias("cited"), F.count_if((F.col("conv_id") + F.col("number")) % 3 == 0).alias("relevant"))
    real = F.filter(F.regexp_extract_all("answer", F.lit(r"[^。！？.\n]+[。！？.]?"), F.lit(0)), lambda s: F.trim(s) != "")
    rows = stored.select(
        "conv_id", "turn", (F.col("turn") % 4 != 3).alias("answerable"), (F.length("answer") < 120).alias("refused"), F.col("answer").contains("the").alias("must"),
        (F.size(F.filter(real, lambda s: F.regexp_like(s, F.lit(_MARK)))) / F.nullif(F.size(real), F.lit(0))).alias("coverage"),
    ).join(cited, ["conv_id", "turn"], "left")
    answerable, refused = F.col("answerable"), F.col("refused")
    answered = answerable & ~refused
    rate = lambda a, b: F.round(F.count_if(a) / F.count_if(b), 4)
    return rows.agg(
        F.count("*").alias("questions"), F.count_if(answerable).alias("answerable"), F.count_if(answered).alias("answered"),
        F.round(F.avg(F.when(answered, F.col("coverage"))), 4).alias("citation_coverage"), F.round(F.avg(F.when(answered, F.col("relevant") / F.col("cited"))), 4).alias("citation_precision"),
        F.round(F.avg(F.when(answered, F.coalesce("cited", F.lit(0)))), 2).alias("avg_citations"), F.round(F.avg(F.when(answerable, F.col("must").cast("double"))), 4).alias("must_contain"),
        rate(refused & ~answerable, ~answerable).alias("refusal_rate"), rate(refused & answerable, answerable).alias("over_refusal_rate"),
    )

"""Topics and vendors of items, and the tables of products."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.graph import Rounds
from corpusloom.plans.registry import query
from corpusloom.plans.scoring import _HEAT_SQL, capped_selection, scored
from corpusloom.sources.products import write_product
from corpusloom.sources.tables import SQL, items

# The topics that labels may resolve to.
TOPICS = ["agent", "ai_coding", "reasoning", "multimodal", "image", "video", "audio", "robotics", "rag", "mcp", "memory", "evaluation", "inference", "fine_tuning", "safety", "open_source", "llm", "chips", "funding", "enterprise", "regulation", "research"]
# Other names of topics.
ALIASES = {
    "retrieval_augmented_generation": "rag",
    "retrieval": "rag",
    "vector_search": "rag",
    "agents": "agent",
    "agentic": "agent",
    "ai_agent": "agent",
    "tool_use": "agent",
    "large_language_model": "llm",
    "language_model": "llm",
    "llms": "llm",
    "foundation_model": "llm",
    "model_context_protocol": "mcp",
    "vision": "multimodal",
    "vlm": "multimodal",
    "text_to_image": "image",
    "text_to_video": "video",
    "speech": "audio",
    "tts": "audio",
    "asr": "audio",
    "finetuning": "fine_tuning",
    "sft": "fine_tuning",
    "rlhf": "fine_tuning",
    "training": "fine_tuning",
    "serving": "inference",
    "deployment": "inference",
    "quantization": "inference",
    "benchmark": "evaluation",
    "benchmarks": "evaluation",
    "eval": "evaluation",
    "alignment": "safety",
    "security": "safety",
    "guardrails": "safety",
    "monitoring": "inference",
    "tracing": "inference",
    "observability": "inference",
    "serving_infra": "inference",
    "coding": "ai_coding",
    "code_generation": "ai_coding",
    "copilot": "ai_coding",
    "opensource": "open_source",
    "oss": "open_source",
    "investment": "funding",
    "funding_round": "funding",
    "policy": "regulation",
    "compliance": "regulation",
    "gpu": "chips",
    "hardware": "chips",
    "semiconductor": "chips",
    "paper": "research",
    "papers": "research",
    "java": "ai_coding",
    "java_ai": "ai_coding",
    "spring": "ai_coding",
    "spring_ai": "ai_coding",
    "python": "ai_coding",
    "python_ai": "ai_coding",
    "cloud_ai": "inference",
    "embedding": "rag",
    "embeddings": "rag",
    "reranker": "rag",
    "reranking": "rag",
    "business": "enterprise",
}
#: labels as a model might say them, dealt by number with a title's first word behind some
SAID = ["Retrieval-Augmented Generation", "LLMs", " agents ", "chips", "Robotics!", "videos", "GPU", "Fine Tuning", "unheard of", "", "business", "memorys", "Open/Source", "MCP"]


def topic_of(label: Column) -> Column:
    """The topic of a label: itself as a slug, by another name, or without a plural's s; else null."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    named = F.create_map(*[F.lit(v) for pair in ALIASES.items() for v in pair])[slug]
    single = F.regexp_replace(slug, "s$", "")
    return F.when(slug.isin(TOPICS), slug).when(named.isNotNull(), named).when(single.isin(TOPICS), single)


_SAID = "CASE item_id % 15 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(SAID)) + " ELSE split_part(title, ' ', 1) END"
_LIST = "('" + "', '".join(TOPICS) + "')"
_ALIAS = ", ".join(f"('{a}', '{b}')" for a, b in ALIASES.items())


@query(f"""WITH {SQL}, alias AS (SELECT * FROM (VALUES {_ALIAS}) t(name, topic)), l AS (SELECT item_id, {_SAID} AS label FROM item), s AS (SELECT *, trim(regexp_replace(lower(trim(label)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM l)
SELECT item_id, label, CASE WHEN slug IN {_LIST} THEN slug WHEN topic IS NOT NULL THEN topic WHEN ends_with(slug, 's') AND left(slug, -1) IN {_LIST} THEN left(slug, -1) END AS topic FROM s LEFT JOIN alias ON name = slug""")
def g16_normalize_topic(spark, sf_dir):
    """Labels that stand for a model's, and the topics they resolve to."""
    said = F.coalesce(F.get(F.array(*[F.lit(s) for s in SAID]), (F.col("item_id") % 15).cast("int")), F.split_part("title", F.lit(" "), F.lit(1)))
    return items(spark, sf_dir).select("item_id", said.alias("label"), topic_of(said).alias("topic"))


_NAMED = """named AS (SELECT item_id, title, summary, unnest(names) AS name, unnest(range(1, len(names) + 1)) AS place FROM (SELECT item_id, title, substr(body, length(title) + 2, 180) AS summary, list_distinct(list_concat(regexp_extract_all(title, '[A-Z][a-z]+')[1:2], regexp_extract_all(body, '[A-Z][a-z]+')[3:5])) AS names FROM (SELECT item_id, title, body FROM item)))"""


def item_entities(spark, sf_dir):
    """item_id, name, role, confidence, title, summary: names that stand for extracted entities."""
    found = F.array_distinct(F.concat(F.slice(F.regexp_extract_all("title", F.lit("[A-Z][a-z]+"), F.lit(0)), 1, 2), F.slice(F.regexp_extract_all("body", F.lit("[A-Z][a-z]+"), F.lit(0)), 3, 3)))
    rows = items(spark, sf_dir).select("item_id", "title", F.substring(F.col("body"), F.length("title") + 2, F.lit(180)).alias("summary"), F.explode(found).alias("name"))
    kind = (F.length("name") + F.col("item_id")) % 3
    role = F.when(kind == 0, "subject").when(kind == 1, "object").otherwise("mention")
    return rows.withColumns({"role": role, "confidence": F.when(F.col("item_id") % 11 > 0, F.round(0.55 + (F.length("name") * 13 + F.col("item_id")) % 45 / 100.0, 2))})


@query(f"""WITH {SQL}, {_NAMED}, c AS (SELECT item_id, name, 'v' || (length(name) % 4) AS vendor, CASE (length(name) + item_id) % 3 WHEN 0 THEN 'subject' WHEN 1 THEN 'object' ELSE 'mention' END AS role, coalesce(CASE WHEN item_id % 11 > 0 THEN round(0.55e0 + (length(name) * 13 + item_id) % 45 / 100e0, 2) END, 0.5e0) AS confidence,
  contains(lower(title), lower(name)) AS in_title, contains(lower(summary), lower(name)) AS in_summary FROM named),
k AS (SELECT *, CASE WHEN role = 'subject' AND confidence >= 0.75 AND (in_title OR in_summary) THEN 'primary' WHEN role = 'subject' AND confidence >= 0.85 THEN 'related' WHEN role = 'object' AND confidence >= 0.65 THEN 'related' WHEN role = 'mention' AND confidence >= 0.75 AND in_title THEN 'related' ELSE 'mention' END AS level,
  CASE WHEN role = 'subject' AND in_title THEN 'subject_in_title' WHEN role = 'subject' AND in_summary THEN 'subject_in_summary_lead' WHEN role = 'subject' THEN 'subject_context' WHEN role = 'object' THEN 'comparison_or_object' WHEN in_title THEN 'title_mention' ELSE 'passing_mention' END AS reason FROM c),
s AS (SELECT *, round(least(1e0, CASE level WHEN 'primary' THEN 0.78e0 WHEN 'related' THEN 0.48 ELSE 0.12 END + confidence * 0.17 + CASE WHEN in_title THEN 0.05 ELSE 0 END), 4) AS score FROM k)
SELECT item_id, vendor, level, reason, score, name FROM s QUALIFY row_number() OVER (PARTITION BY item_id, vendor ORDER BY CASE level WHEN 'primary' THEN 3 WHEN 'related' THEN 2 ELSE 1 END DESC, score DESC, name) = 1""")
def g17_vendor_relation(spark, sf_dir):
    """How an item relates to each vendor that its entities belong to (here: by the length of the name): the strongest relation, why, and how strong."""
    rows = item_entities(spark, sf_dir)
    sure = F.coalesce("confidence", F.lit(0.5))
    in_title, in_summary = F.lower("title").contains(F.lower("name")), F.lower("summary").contains(F.lower("name"))
    role = F.col("role")
    level = F.when((role == "subject") & (sure >= 0.75) & (in_title | in_summary), "primary").when((role == "subject") & (sure >= 0.85), "related").when((role == "object") & (sure >= 0.65), "related")
    level = level.when((role == "mention") & (sure >= 0.75) & in_title, "related").otherwise("mention")
    reason = F.when((role == "subject") & in_title, "subject_in_title").when((role == "subject") & in_summary, "subject_in_summary_lead").when(role == "subject", "subject_context").when(role == "object", "comparison_or_object")
    rows = rows.select("item_id", "name", F.concat(F.lit("v"), (F.length("name") % 4).cast("string")).alias("vendor"), level.alias("level"), reason.when(in_title, "title_mention").otherwise("passing_mention").alias("reason"), sure.alias("sure"), in_title.alias("in_title"))
    base = F.when(F.col("level") == "primary", 0.78).when(F.col("level") == "related", 0.48).otherwise(0.12)
    rows = rows.withColumn("score", F.round(F.least(F.lit(1.0), base + F.col("sure") * 0.17 + F.when(F.col("in_title"), 0.05).otherwise(0.0)), 4))
    rank = F.when(F.col("level") == "primary", 3).when(F.col("level") == "related", 2).otherwise(1)
    order = W.partitionBy("item_id", "vendor").orderBy(F.desc(rank), F.desc("score"), "name")
    return rows.withColumn("r", F.row_number().over(order)).filter("r = 1").select("item_id", "vendor", "level", "reason", "score", "name")


@query(f"""WITH {SQL}, {_HEAT_SQL}, s AS (SELECT day, source_id, item_id, score, row_number() OVER (PARTITION BY day, source_id ORDER BY score DESC, item_id) AS r FROM scored), c AS (SELECT day, item_id, row_number() OVER (PARTITION BY day ORDER BY score DESC, item_id) AS position FROM s WHERE r <= 3)
SELECT day, item_id, position, ends_with(day, '3') AS rewritten FROM c WHERE position <= CASE WHEN ends_with(day, '3') THEN 2 ELSE 12 END""")
def a10_write_product(spark, sf_dir):
    """The daily choice written by day, and some days (those that end in 3) written again, shorter: the others stay as they were."""
    path = f"{Rounds(spark, 'product').root}/selection"
    chosen = capped_selection(scored(spark, sf_dir)).select("day", "item_id", F.col("position").cast("long").alias("position"))
    write_product(chosen.withColumn("rewritten", F.lit(False)), path, ["day"])
    write_product(chosen.filter(F.col("day").endswith("3") & (F.col("position") <= 2)).withColumn("rewritten", F.lit(True)), path, ["day"])
    return spark.read.schema("item_id long, position long, rewritten boolean, day string").parquet(path).select("day", "item_id", "position", "rewritten")

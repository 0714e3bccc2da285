"""What a question asks for: its type, its window of time, whether it is about the collection itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.sources.tables import ZONE

# Types of question by the first pattern that fits; else explainer.
QUESTION_TYPES = [
    ("timeline", "时间线|先后|一步步|怎么发展|演进|从.*到.*发生|发布顺序|什么顺序|时间顺序|timeline"),
    ("comparison", "相比|对比|区别|差距|哪个更|和.*比|vs\\.?|versus"),
    ("explainer", "为什么|怎么(实现|做到|工作|运作)|原理|是什么意思|如何实现"),
    ("recent_updates", "最近|近期|本周|今天|昨天|这几天|有哪些新|新动作|更新了"),
    ("fact_check", "是多少|叫什么|几个|是谁|多少参数|真的吗|是否|确认|是哪个|是哪些|哪个模型|哪家"),
    ("recommendation", "推荐|值得|该用|选哪个"),
]
# Words for windows of time, tried in this order.
WINDOWS = [
    ("today", "今天|今日|today"),
    ("yesterday", "昨天|昨日|yesterday"),
    ("last_week", "上周|上个星期|last week"),
    ("this_week", "本周|这周|这个星期|this week"),
    ("last_month", "上个?月|last month"),
    ("this_month", "本月|这个月|this month"),
    ("weeks", "(?:过去|近|最近|last|past)\\s*(\\d{1,2})\\s*(?:周|星期|weeks?)"),
    ("days", "(?:过去|近|最近|last|past)\\s*(\\d{1,3})\\s*(?:天|日|days?)"),
    ("recent", "最近|近期|这几天|现在|目前|当前|如今|眼下|recent|lately|currently|right now"),
]
# Wordings that ask about the collection.
ABOUT_COLLECTION = [
    "(有哪些|有什么|多少个?|哪些)\\s*(信源|来源|数据源|站点|网站)",
    "(收录|采集|抓取|索引)了?\\s*(多少|哪些|什么)",
    "(数据|内容|资讯|语料)\\s*(从哪|来自哪|哪里来|有多少|多不多)",
    "(多久|多长时间|什么频率|多频繁).{0,6}(更新|采集|抓取)",
    "(更新|数据).{0,4}(到什么时候|到哪天|多新|新不新)",
    "(你|系统|本站|这个网站|平台).{0,8}(能做什么|怎么工作|覆盖|范围)",
    "(信源|来源|数据源|语料|收录|索引|内容)(的)?(情况|状态|规模|覆盖|构成)",
    "(信源|数据源|语料|收录).{0,5}(怎么样|如何|多不多|全不全)",
]
RECENT_DAYS, UNSPECIFIED_DAYS = 7, 30


def first_match(col: Column, patterns: list[tuple[str, str]], default: str | None) -> Column:
    return reduce(lambda rest, p: F.when(F.regexp_like(col, F.lit(p[1])), F.lit(p[0])).otherwise(rest), reversed(patterns), F.lit(default))


def first_match_sql(col: str, patterns: list[tuple[str, str]], default: str | None) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{p}') THEN '{name}'" for name, p in patterns) + f" ELSE {'NULL' if default is None else repr(default)} END"


def question_type(question: Column) -> Column:
    return first_match(question, QUESTION_TYPES, "explainer")


def window_kind(question: Column) -> Column:
    """Which window's words a question has; an updates question without any has the default one; else null."""
    kind = first_match(question, WINDOWS, None)
    return F.coalesce(kind, F.when(question_type(question) == "recent_updates", F.lit("default")))


def window_bounds(question: Column, kind: Column, asked_at: Column) -> tuple[Column, Column]:
    """Begin and end (excluded) of a kind of window, in local time of the display zone."""
    now = F.from_utc_timestamp(asked_at, ZONE)
    midnight, week, month = (F.date_trunc(unit, now) for unit in ("day", "week", "month"))
    number = lambda name: F.regexp_extract(question, dict(WINDOWS)[name], 1).try_cast("int")
    ago = lambda days: now - F.make_interval(days=days)
    begin = (
        F.when(kind == "today", midnight)
        .when(kind == "yesterday", midnight - F.expr("INTERVAL 1 DAY"))
        .when(kind == "last_week", week - F.expr("INTERVAL 7 DAY"))
        .when(kind == "this_week", week)
        .when(kind == "last_month", F.add_months(month, -1).cast("timestamp"))
        .when(kind == "this_month", month)
        .when(kind == "weeks", ago(number("weeks") * 7))
        .when(kind == "days", ago(number("days")))
        .when(kind == "recent", ago(F.lit(RECENT_DAYS)))
        .when(kind == "default", ago(F.lit(UNSPECIFIED_DAYS)))
    )
    end = (
        F.when(kind == "today", midnight + F.expr("INTERVAL 1 DAY"))
        .when(kind == "yesterday", midnight)
        .when(kind == "last_week", week)
        .when(kind == "this_week", week + F.expr("INTERVAL 7 DAY"))
        .when(kind == "last_month", month)
        .when(kind == "this_month", F.add_months(month, 1).cast("timestamp"))
        .when(kind.isNotNull(), now)
    )
    return begin, end


def about_collection(question: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.regexp_like(question, F.lit(p)) for p in ABOUT_COLLECTION])

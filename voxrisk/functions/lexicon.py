"""Default word lists and the rule-set profiles that use them.

Every list is a parameter of the operators that take it; these are the defaults.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

# --- Fixed values: word lists --------------------------------------------------

POSITIVE_V2 = (
    "好", "棒", "赞", "优秀", "厉害", "牛逼", "支持", "喜欢",
    "爱", "感谢", "开心", "高兴", "满意", "完美", "精彩",
    "不错", "很好", "真好", "太好了", "赞赞",
)
NEGATIVE_V2 = (
    "差", "烂", "垃圾", "恶心", "讨厌", "恨", "愤怒", "生气",
    "失望", "糟糕", "废物", "傻", "蠢", "坑", "无语",
    "不好", "很差", "太差",
)
POSITIVE_V1 = (
    "好", "棒", "赞", "优秀", "厉害", "牛逼", "支持", "喜欢",
    "爱", "感谢", "开心", "高兴", "满意", "完美", "精彩",
)
NEGATIVE_V1 = (
    "差", "烂", "垃圾", "恶心", "讨厌", "恨", "愤怒", "生气",
    "失望", "糟糕", "废物", "傻", "蠢", "坑",
)

RUMOR, ATTACK, INCITEMENT, EXTREME = "谣言类", "攻击类", "煽动类", "极端情绪"

SENSITIVE_V2 = {
    RUMOR: (
        "谣言", "真相", "辟谣", "反转", "阴谋", "洗地", "带节奏", "水军",
        "机器人", "五毛", "美分", "带路党",
    ),
    ATTACK: (
        "垃圾", "傻逼", "脑残", "智障", "弱智", "白痴", "废物", "傻叉", "傻缺",
        "二逼", "草泥马", "妈的", "他妈", "操", "艹", "死", "滚",
    ),
    INCITEMENT: (
        "转发", "扩散", "让更多人知道", "必须曝光", "大家快看", "震惊", "突发",
        "紧急", "重要通知", "速看",
    ),
    EXTREME: (
        "恶心", "呕吐", "愤怒", "气愤", "忍无可忍", "无法忍受", "受不了", "崩溃",
        "绝望", "愤怒到极点",
    ),
}
# Used when no word file of a configured folder can be loaded.
SENSITIVE_V2_FALLBACK = {
    RUMOR: ("谣言", "真相", "辟谣", "反转", "阴谋", "洗地", "带节奏"),
    ATTACK: ("垃圾", "傻逼", "脑残", "智障", "废物", "白痴"),
    INCITEMENT: ("转发", "扩散", "让更多人知道", "必须曝光"),
    EXTREME: ("恶心", "呕吐", "愤怒", "气愤", "忍无可忍"),
}
SENSITIVE_V1 = (
    "谣言", "真相", "辟谣", "反转", "阴谋", "洗地", "带节奏",
    "垃圾", "傻逼", "脑残", "智障", "弱智", "白痴", "废物",
    "转发", "扩散", "让更多人知道", "必须曝光",
    "恶心", "呕吐", "愤怒", "气愤", "忍无可忍",
)
TOPIC_SENSITIVE = (
    "谣言", "真相", "辟谣", "反转", "阴谋",
    "转发", "扩散", "让更多人知道", "必须曝光",
    "洗地", "带节奏", "水军", "机器人",
)
CONCENTRATION_WORDS = ("谣言", "真相", "辟谣", "转发", "扩散")

STOPWORDS_BASE = (
    "的", "了", "是", "我", "你", "他", "她", "它", "们",
    "这", "那", "就", "也", "都", "在", "有", "和", "与",
    "或", "但", "而", "如果", "因为", "所以", "虽然", "但是",
    "什么", "怎么", "为什么", "哪", "谁", "多少", "几",
    "啊", "呢", "吧", "吗", "呀", "哦", "嗯", "哈",
)
STOPWORDS_V2 = STOPWORDS_BASE + ("一个", "这个", "那个", "不是", "没有", "可以", "已经")
STOPWORDS_TOPIC = STOPWORDS_V2 + ("还", "会", "要", "能", "说", "对", "好", "很")
STOPWORDS_CLOUD = (
    "的", "了", "在", "是", "我", "你", "他", "也", "就", "和", "回复", "评论", "视频", "看到",
)

OVERSEAS_NAMES = ("海外", "美国", "日本", "韩国", "英国", "德国", "法国")

PROVINCE_EN = {
    "北京": "Beijing", "上海": "Shanghai", "天津": "Tianjin", "重庆": "Chongqing",
    "河北": "Hebei", "山西": "Shanxi", "辽宁": "Liaoning", "吉林": "Jilin",
    "黑龙江": "Heilongjiang", "江苏": "Jiangsu", "浙江": "Zhejiang", "安徽": "Anhui",
    "福建": "Fujian", "江西": "Jiangxi", "山东": "Shandong", "河南": "Henan",
    "湖北": "Hubei", "湖南": "Hunan", "广东": "Guangdong", "海南": "Hainan",
    "四川": "Sichuan", "贵州": "Guizhou", "云南": "Yunnan", "陕西": "Shaanxi",
    "甘肃": "Gansu", "青海": "Qinghai", "中国台湾": "China Taiwan", "内蒙古": "Inner Mongolia",
    "广西": "Guangxi", "西藏": "Tibet", "宁夏": "Ningxia", "新疆": "Xinjiang",
    "中国香港": "China Hong Kong", "中国澳门": "China Macao", "未知": "Unknown", "海外": "Overseas",
}

# --- Profiles ------------------------------------------------------------------

Categorised = tuple[tuple[str, str], ...]


def categorised(groups: dict[str, Iterable[str]]) -> Categorised:
    """(word, category) pairs; a word named twice keeps its later category."""
    by_word: dict[str, str] = {}
    for category, words in groups.items():
        for word in words:
            by_word[word] = category
    return tuple(by_word.items())


@dataclass(frozen=True)
class Profile:
    """Word lists of one rule set. ``name`` selects the scoring formulas."""

    name: str
    positive: Sequence[str]
    negative: Sequence[str]
    sensitive: Categorised
    stopwords: Sequence[str]
    topic_sensitive: Sequence[str] = field(default=TOPIC_SENSITIVE)
    concentration: Sequence[str] = field(default=CONCENTRATION_WORDS)
    overseas: Sequence[str] = field(default=OVERSEAS_NAMES)


V2 = Profile("v2", POSITIVE_V2, NEGATIVE_V2, categorised(SENSITIVE_V2), STOPWORDS_V2)
V1 = Profile("v1", POSITIVE_V1, NEGATIVE_V1, categorised({"": SENSITIVE_V1}), STOPWORDS_TOPIC)

# Word lists up to this size are one literal array in the plan; longer ones are met by operators.wordsearch, with the same result.
MAX_INLINE_WORDS = 2000


def read_words(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """Word file(s), one word per line; blank and ``#`` lines are skipped."""
    word = F.trim(F.regexp_replace("value", r"[\t\r﻿]", ""))
    words = (
        spark.read.text(path)
        .select(word.alias("word"))
        .filter((F.col("word") != "") & ~F.col("word").startswith("#"))
        .distinct()
    )
    return words if category is None else words.withColumn("category", F.lit(category))


def read_sensitive(spark: SparkSession, files: dict[str, str]) -> Categorised:
    """(word, category) pairs from one word file per category, for a ``Profile``.

    Missing files are skipped; a word in two files takes the later category; when no file
    loads, the fallback list is used. The list may have any length that the driver holds.
    """
    found: DataFrame | None = None
    for place, (category, path) in enumerate(files.items()):
        try:
            words = read_words(spark, path, category).withColumn("place", F.lit(place))
        except AnalysisException:  # no such file
            continue
        found = words if found is None else found.unionByName(words)
    if found is None:
        return categorised(SENSITIVE_V2_FALLBACK)
    last = found.groupBy("word").agg(F.max_by("category", "place").alias("category"), F.max("place").alias("place"))
    return tuple((row.word, row.category) for row in last.orderBy("place", "word").collect())


def inline_words(words: DataFrame) -> list[str] | None:
    """The words as a list when they fit in the plan, else None."""
    rows = words.select("word").orderBy("word").limit(MAX_INLINE_WORDS + 1).collect()
    return None if len(rows) > MAX_INLINE_WORDS else [row.word for row in rows]

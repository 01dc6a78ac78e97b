"""How a client ranks and names situations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PHASE_BONUS = {"active": 500, "developing": 300, "emerging": 100, "declining": -200}
#: Words of a title that place it, by region, the first that meets.
HINTS = [
    (r"\b(southeast\s*asia|vietnam|thailand|myanmar|philippines|indonesia|laos|cambodia|malaysia)\b", "southeast-asia"),
    (r"\b(middle\s*east|iran|israel|iraq|syria|lebanon|yemen|gaza|saudi|jordan|kuwait)\b", "middle-east"),
    (r"\b(ukraine|russia|eastern\s*europe|belarus|moldova|georgia)\b", "eastern-europe"),
    (r"\b(sahel|niger|mali|burkina|chad|nigeria|congo|african|africa|sudan|somalia|eritrea|ethiopia)\b", "sub-saharan-africa"),
    (r"\b(china|japan|korea|taiwan|east\s*asia)\b", "east-asia"),
    (r"\b(india|pakistan|afghanistan|south\s*asia|bangladesh|nepal|sri\s*lanka)\b", "south-asia"),
    (r"\b(germany|france|uk\b|britain|europe|nato|eu\b|western\s*europe)\b", "western-europe"),
    (r"\b(north\s*america|united\s*states|canada|mexico)\b", "north-america"),
    (r"\b(south\s*america|brazil|argentina|chile|colombia|venezuela)\b", "south-america"),
    (r"\b(oceania|australia|new\s*zealand|pacific)\b", "oceania"),
    (r"\b(central\s*asia|kazakhstan|uzbek|tajik|kyrgyz|turkmen)\b", "central-asia"),
]


def situation_score(severity_rank: Column, sources: Column, hours: Column, events: Column, phase: Column, children: Column, certainty: Column) -> Column:
    """Rank of a situation: by severity, then sources, freshness, the logarithm of its events, phase, children and certainty (null: not known)."""
    bonus = None
    for k, v in PHASE_BONUS.items():
        bonus = F.when(F.coalesce(phase, F.lit("emerging")) == k, v) if bonus is None else bonus.when(F.coalesce(phase, F.lit("emerging")) == k, v)
    fresh = F.when(hours < 1, 1500).when(hours < 3, 800).when(hours < 6, 300).otherwise(0)
    volume = F.floor(F.log2(F.greatest(events, F.lit(1))) * 30 + 0.5)
    sure = F.coalesce(F.floor(certainty * 500 + 0.5), F.lit(0))
    return (severity_rank * 10000 + F.least(sources, F.lit(4)) * 2000 + fresh + volume + bonus.otherwise(0) + F.least(children * 50, F.lit(500)) + sure).cast("long")


def primary_region(codes: Column, title: Column) -> Column:
    """The one long code there is; else what the title hints at, first among the codes; else global of four or more; else the first."""
    long = F.filter(codes, lambda x: F.length(x) > 2)
    low = F.lower(F.coalesce(title, F.lit("")))
    known = hinted = None
    for pattern, region in HINTS:
        meets = low.rlike(pattern)
        inside = meets & F.array_contains(codes, region)
        known = F.when(inside, region) if known is None else known.when(inside, region)
        hinted = F.when(meets, region) if hinted is None else hinted.when(meets, region)
    rest = F.when(F.size(codes) >= 4, "global").otherwise(F.coalesce(F.get(long, F.lit(0)), F.get(codes, F.lit(0))))
    return F.when(F.size(codes) == 0, "global").when(F.size(long) == 1, F.get(long, F.lit(0))).otherwise(F.coalesce(known, hinted, rest))


#: Patterns of the news list's filters.
NEWS_FILTERS = {
    "middle_east": "middle.east|israel|palestine|gaza|iran|iraq|syria|yemen|lebanon|houthi|hezbollah|hamas|saudi|jordan|egypt|suez",
    "ukraine": "ukraine|russia|kyiv|moscow|donbas|crimea|zelensk|putin|kherson|bakhmut|zaporizhzhia|kursk",
    "cyber": "cyber|hack|breach|malware|ransomware|vulnerability|zero.day|exploit|apt|threat|phishing|ddos|botnet|infosec",
}


def in_news_filter(event_type: Column, payload: Column, name: str) -> Column:
    """Whether an article belongs to a filter's list, by title, address, region, summary and topics; other filters take all articles."""
    of = lambda p: F.get_json_object(payload, p)
    topics = F.array_join(F.from_json(of("$.enrichment.topics"), "array<string>"), " ")
    parts = (F.coalesce(of("$.enrichment.translated_title"), of("$.title")), of("$.url"), of("$.region"), F.coalesce(of("$.enrichment.summary"), of("$.summary")), topics)
    text = F.lower(F.concat_ws(" ", *(F.coalesce(x, F.lit("")) for x in parts)))
    return (event_type == "news_article") & (text.rlike(NEWS_FILTERS[name]) if name in NEWS_FILTERS else F.lit(True))

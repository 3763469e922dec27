"""Studies: keywords times scopes, validated and laid out in running order."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.functions import fixed_values as V
from murmura.functions.text import MODES, keyword_terms

MOST_SEARCHES = 50
_GROUP = re.compile(rf"https?://(?:[\w-]+\.)*(?:{'|'.join(map(re.escape, V.SITE_HOSTS))})(?::\d*)?/+groups/+([^/?#]+)", re.I)


def _group_address(url: str) -> str | None:
    found = _GROUP.match(url.strip())
    return f"{V.SITE}/groups/{found[1]}/" if found else None


@dataclass
class Study:
    """What to search: each keyword globally, in each group and on the marketplace."""

    name: str
    keywords: list[str]
    groups: list[str] = field(default_factory=list)
    include_global: bool = True
    include_marketplace: bool = False
    max_results: int = 20
    match_mode: str = "phrase"
    include_comments: bool = False
    pause_seconds: tuple[float, float] = (5.0, 15.0)
    max_minutes_per_search: float = 15.0

    @classmethod
    def from_dict(cls, raw: dict) -> Study:
        """A study of a dict; unknown fields raise ValueError."""
        if unknown := sorted(set(raw) - set(cls.__dataclass_fields__)):
            raise ValueError(f"unknown fields: {', '.join(unknown)}")
        if "name" not in raw or "keywords" not in raw:
            raise ValueError("a study needs a name and keywords")
        return cls(**raw).validated()

    def validated(self) -> Study:
        """The study with distinct keywords (first spelling) and groups (by root); ValueError names what is wrong."""
        seen: dict[str, str] = {}
        for k in (term for keyword in self.keywords for term in keyword_terms(keyword)):
            seen.setdefault(k.lower(), k)
        roots = [_group_address(g) for g in self.groups]
        problems = {
            "a study needs a name": not (self.name or "").strip(), "a study needs keywords": not seen, "a group URL is none": None in roots,
            f"match_mode must be one of {', '.join(MODES)}": self.match_mode not in MODES, "max_results must be 1 to 100": not 1 <= self.max_results <= 100,
            "pause_seconds must be two rising numbers": len(self.pause_seconds) != 2 or not 0 <= self.pause_seconds[0] <= self.pause_seconds[1],
            "max_minutes_per_search must be positive": self.max_minutes_per_search <= 0, "nowhere to search": not (self.include_global or self.groups or self.include_marketplace),
        }
        if wrong := next((text for text, holds in problems.items() if holds), None):
            raise ValueError(wrong)
        done = Study(**{**self.__dict__, "keywords": list(seen.values()), "groups": list(dict.fromkeys(roots)), "pause_seconds": tuple(self.pause_seconds)})
        if (searches := len(done.keywords) * len(done.scopes())) > MOST_SEARCHES:
            raise ValueError(f"{searches} searches; at most {MOST_SEARCHES} are allowed")
        return done

    def scopes(self) -> list[tuple[str, str | None]]:
        return [("global", None)] * self.include_global + [("group", g) for g in self.groups] + [("marketplace", None)] * self.include_marketplace

    def plan(self, spark: SparkSession) -> DataFrame:
        """search, keyword, scope, group_url, comments: keyword by keyword; no comments on the marketplace."""
        rows = [(k, scope, group) for k in self.keywords for scope, group in self.scopes()]
        plan = spark.createDataFrame([(n, *r) for n, r in enumerate(rows, 1)], "search INT, keyword STRING, scope STRING, group_url STRING")
        return plan.withColumn("comments", F.lit(self.include_comments) & (F.col("scope") != "marketplace"))

    def estimated_minutes(self, seconds_per_result: float = 15.0) -> int:
        """A search takes its results' time and a minute, max_minutes_per_search at most; between two there is a pause."""
        searches = len(self.keywords) * len(self.scopes())
        each = min(self.max_minutes_per_search, self.max_results * seconds_per_result / 60 + 1)
        return round(searches * each + max(searches - 1, 0) * sum(self.pause_seconds) / 2 / 60)

    def described(self) -> dict:
        """name, searches, plan (keyword and where) and estimated_minutes, to be confirmed before anything runs."""
        plan = [{"keyword": k, "scope": group or scope} for k in self.keywords for scope, group in self.scopes()]
        return {"name": self.name, "searches": len(plan), "plan": plan, "estimated_minutes": self.estimated_minutes()}


def plan_of(keywords: DataFrame, scopes: DataFrame) -> DataFrame:
    """The plan of keyword(position, keyword) and scope(position, scope) tables, keyword by keyword.

    All entries are planned, however many; only a ``Study`` refuses more than MOST_SEARCHES searches.
    """
    k = keywords.select(F.col("position").alias("keyword_position"), "keyword")
    s = scopes.select(F.col("position").alias("scope_position"), "scope")
    return k.crossJoin(s).orderBy("keyword_position", "scope_position")

"""Questions in plain words answered by rules: the first intent that fits chooses a query."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Answer:
    text: str
    ids: list[str]


def answer(question: str, developments: DataFrame, routes: DataFrame) -> Answer:
    """developments: (app_id, units, status, water, transport, schools, overall); routes: (route_id, length_km, serves_app_ids).

    Intents in order: a named application, a named route, a ranking by a system's
    score, routes, status, overview. Answers carry at most the rows of a top list.
    """
    q = question.strip()
    if not q:
        raise ValueError("empty question")
    words = re.findall(r"[A-Za-z0-9/-]{4,}", q.upper())
    named = developments.where(F.upper("app_id").isin(words)).limit(1).collect()
    if named:
        r = named[0]
        return Answer(f"{r.app_id}: {r.units} units, {r.status}, overall {r.overall}", [r.app_id])
    way = routes.where(F.upper("route_id").isin(re.findall(r"[A-Z]+\d+", q.upper()))).limit(1).collect()
    if way:
        return Answer(f"{way[0].route_id}: {way[0].length_km} km", list(way[0].serves_app_ids or []))
    m = re.search(r"\b(?:top|worst)\s+(\d+)", q, re.I)
    n = max(1, min(100, int(m.group(1)))) if m else 5
    for name in ("cost", "distance"):
        if re.search(rf"\b{name}s?\b|\b{'expensive' if name == 'cost' else 'far(?:thest)?'}\b", q, re.I) and name in developments.columns:
            top = developments.where(F.col(name).isNotNull()).orderBy(F.desc(name), "app_id").limit(n).collect()
            return Answer(f"by {name}: " + ", ".join(f"{r.app_id} ({r[name]})" for r in top), [r.app_id for r in top])
    for name in ("water", "transport", "schools", "overall"):
        if re.search(rf"\b{name}\b", q, re.I) or (name == "overall" and m):
            top = developments.where(F.col(name).isNotNull()).orderBy(F.desc(name), "app_id").limit(n).collect()
            return Answer(f"by {name}: " + ", ".join(f"{r.app_id} ({r[name]})" for r in top), [r.app_id for r in top])
    if re.search(r"\b(route|bus)e?s?\b", q, re.I):
        s = routes.agg(F.count("*").alias("n"), F.sum("length_km").alias("km")).first()
        return Answer(f"{s.n} routes, {s.km or 0} km", [])
    if re.search(r"\b(largest|biggest|most units|size)\b", q, re.I):
        top = developments.orderBy(F.col("units").desc_nulls_last(), "app_id").limit(n).collect()
        return Answer("largest: " + ", ".join(f"{r.app_id} ({r.units})" for r in top), [r.app_id for r in top])
    status = re.search(r"\b(granted|pending|refused|appealed|withdrawn)\b", q, re.I)
    if status:
        some = developments.where(F.col("status") == status.group(1).lower())
        top = some.orderBy(F.desc("units"), "app_id").limit(n).collect()
        return Answer(f"{some.count()} {status.group(1).lower()}", [r.app_id for r in top])
    s = developments.agg(F.count("*").alias("n"), F.sum("units").alias("u")).first()
    return Answer(f"{s.n} developments, {s.u or 0} units", [])


def known_only(ids: list[str], developments: DataFrame) -> list[str]:
    """The ids that exist, in the order given. `ids` is a short list."""
    have = {r.app_id for r in developments.where(F.col("app_id").isin(ids)).select("app_id").distinct().collect()}
    return [i for i in dict.fromkeys(ids) if i in have]


def answer_with(model: Callable[[str, list[dict]], Answer] | None, question: str, developments: DataFrame, routes: DataFrame, context: int = 30) -> Answer:
    """A model's answer from the question and the largest developments, with the ids that exist; the rules' answer where there is no model or it fails."""
    if model is not None:
        try:
            top = developments.orderBy(F.col("units").desc_nulls_last(), "app_id").limit(context).toPandas().to_dict("records")
            got = model(question, top)
            return Answer(got.text, known_only(got.ids, developments))
        except Exception:  # whatever a model raises, the rules answer
            logging.getLogger(__name__).warning("model failed", exc_info=True)
    return answer(question, developments, routes)

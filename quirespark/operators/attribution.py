"""Who says what: the likeliest speakers of a chapter's quotes, decoded together."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quirespark.shared import partitions

#: What counts for and against a speaker.
WEIGHTS = {
    "explicit": 12.0, "explicit_miss": -6.0, "gender_ok": 2.5, "gender_bad": -3.5, "addressed": -3.5, "recent": 1.2,
    "same_para_repeat": -0.5, "new_para_repeat": -2.5, "aba": 2.0, "replies_to_addressed": 2.0, "split_same": 6.0, "split_diff": -6.0,
    "group_other": -1.0, "cont_same": 4.0, "cont_diff": -2.0, "other_ok": 4.0, "other_bad": -3.0, "lead": 0.6, "prior": 0.7,
}
#: Speakers that are groups.
GROUPS = {"Crowd", "Guest", "Guests", "Servants", "Officers", "Jews", "Disciples", "Pharisees"}


def _own(q: dict, who: str, genders: dict, named: Counter) -> float:
    """How well a quote by itself suits a speaker."""
    w, total = WEIGHTS, WEIGHTS["prior"] * math.log1p(named[who])
    gendered = q["pron"] in ("m", "f") and not q["explicit"]
    if q["explicit"]:
        total += w["explicit" if who == q["explicit"] else "explicit_miss"]
    if gendered and genders.get(who):
        total += w["gender_ok" if genders[who] == q["pron"] else "gender_bad"]
    if gendered and who in GROUPS:
        total += w["group_other"]
    if gendered and who == q["lead"]:
        total += w["lead"]
    if who in q["addressed"] and who != q["explicit"]:
        total += w["addressed"]
    return total + (w["recent"] if who in q["recent"] else 0.0)


def _step(q0: dict, q1: dict, before: str | None, last: str, now: str) -> float:
    """How well `now` follows `last`, who followed `before`."""
    w, together, same = WEIGHTS, q0["para"] == q1["para"], now == last
    if together and q1["split"]:
        return w["split_same" if same else "split_diff"]
    if q1["other"]:
        return w["other_ok" if not same and (now == before or now in q0["addressed"]) else "other_bad"]
    if together and q1["cont"]:
        return w["cont_same" if same else "cont_diff"]
    if same:
        return w["same_para_repeat" if together else "new_para_repeat"]
    return (w["aba"] if now == before and not together else 0.0) + (w["replies_to_addressed"] if now in q0["addressed"] else 0.0)


def _total(x: np.ndarray, axis=None) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis=axis)


def decode(quotes: list[dict], genders: dict[str, str]) -> tuple[list[str], list[float]]:
    """The likeliest speakers, and the probability of each. A state is a speaker with the one before: arrays hold
    [speaker, speaker before]; ties go to the candidate that comes first."""
    if not quotes:
        return [], []
    named = Counter(q["explicit"] for q in quotes if q["explicit"])
    cast = [list(dict.fromkeys([*([q["explicit"]] if q["explicit"] else []), *q["cands"]])) or ["Speaker A"] for q in quotes]
    own = [np.array([_own(q, who, genders, named) for who in c]) for q, c in zip(quotes, cast, strict=True)]
    steps = []  # [now, last, before]
    for i in range(1, len(quotes)):
        befores = cast[i - 2] if i > 1 else [None]
        steps.append(np.array([[[_step(quotes[i - 1], quotes[i], b, a, c) for b in befores] for a in cast[i - 1]] for c in cast[i]]))
    best, sums, back = own[0][:, None], [own[0][:, None]], []
    for i, t in enumerate(steps, 1):
        way = best[None, :, :] + t
        back.append(way.argmax(axis=2))
        best = way.max(axis=2) + own[i][:, None]
        sums.append(_total(sums[-1][None, :, :] + t, axis=2) + own[i][:, None])
    now, last = np.unravel_index(int(best.argmax()), best.shape)
    picks = [int(now)]
    for i in range(len(steps) - 1, -1, -1):
        picks.append(int(last))
        now, last = last, back[i][picks[-2], last]
    picks = picks[::-1]
    later = [np.zeros_like(sums[-1])]
    for i in range(len(steps) - 1, -1, -1):
        ahead = own[i + 1][:, None] + later[-1]  # [next, now]
        later.append(_total(ahead[:, :, None] + steps[i], axis=0))
    sure = []
    for i, (s, z) in enumerate(zip(sums, later[::-1], strict=True)):
        each = _total(s + z, axis=1)
        sure.append(float(np.exp(each[picks[i]] - _total(each))))
    return [c[p] for c, p in zip(cast, picks, strict=True)], sure


def attribute(quotes: DataFrame, genders: dict[str, str] | None = None, chapter: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The columns of `chapter` and `order` (chapter and pos, if not given), speaker and probability for quotes (para,
    explicit, pron, lead, split, cont, other, addressed, recent, cands besides). Chapters are independent; within one the
    speakers depend on each other. `genders` gives roles m or f; where the quotes have a column of that name, a map, it holds
    for the roles that are not given."""
    chapter, order = chapter or ["chapter"], order or ["pos"]
    kinds = dict(quotes.dtypes)
    shape = ", ".join([*(f"`{c}` {kinds[c]}" for c in chapter + order), "speaker string, probability double"])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in order])
        items = rows.to_pylist()
        for q in items:
            q |= {k: q[k] or [] for k in ("addressed", "recent", "cands")}
            q |= {k: q[k] or None for k in ("explicit", "pron", "lead")}
        told = dict(items[0].get("genders") or {}) if items else {}
        speakers, sure = decode(items, told | (genders or {}))
        own = rows.select(chapter + order)
        return own.append_column("speaker", pa.array(speakers, pa.string())).append_column("probability", pa.array(sure, pa.float64()))

    # small rows make much work here, so they are dealt by a number of parts, which are not put together for their few bytes
    dealt = quotes.repartition(partitions(quotes.sparkSession), *chapter)
    return dealt.groupBy(*chapter).applyInArrow(run, shape)

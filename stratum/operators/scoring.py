"""K. Batch / streaming scoring of form submissions, recommendations and
sequence decoding.

Every scorer is a set of column expressions over an all-string submission
frame, so the same code runs in batch and in Structured Streaming.
Random phrase choice is replaced by a hash of (row key, seed, slot).
"""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions.hashing import hash_uniform
from stratum.operators import form as FX
from stratum.operators.encode import leading_int, scaled_answer


def _lit_map(d: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in d.items()))


def _num(v) -> str:
    return str(v)


# ------------------------------------------------------------------ validation

def violation_rules(form=FX.FORM):
    """(field, message, predicate builder) triples — the rules as data."""
    rules = []
    for f in form:
        fid = f["id"]
        rules.append((fid, f"{fid}: required", lambda c: c.isNull() | (F.trim(c) == "")))
        if f["type"] == "number":
            rules.append((fid, f"{fid}: not a number", lambda c: c.isNotNull() & (F.trim(c) != "")
                          & c.try_cast("double").isNull()))
            rules.append((fid, f"{fid}: below {_num(f['min'])}",
                          lambda c, m=f["min"]: c.try_cast("double") < F.lit(float(m))))
            rules.append((fid, f"{fid}: above {_num(f['max'])}",
                          lambda c, m=f["max"]: c.try_cast("double") > F.lit(float(m))))
        else:
            rules.append((fid, f"{fid}: invalid option",
                          lambda c, o=f["options"]: c.isNotNull() & (F.trim(c) != "") & ~c.isin(o)))
    return rules


def validate_answers(df: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, violations array<string>, n_violations) — one projection."""
    checks = [F.when(F.coalesce(pred(F.col(fid)), F.lit(False)), F.lit(msg)) for fid, msg, pred in violation_rules()
              if fid in df.columns]
    v = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return df.select(key, v.alias("violations")).withColumn("n_violations", F.size("violations"))


def violation_counts(df: DataFrame, key: str = "row_id") -> DataFrame:
    """(violation, count) over all submissions."""
    return (validate_answers(df, key).select(F.explode("violations").alias("violation"))
            .groupBy("violation").agg(F.count(F.lit(1)).alias("count")))


# --------------------------------------------------------------------- features

def assemble_scoring_features(df: DataFrame, key: str = "row_id", form=FX.FORM) -> DataFrame:
    """number → double (bad → NULL), 0–5 answers → int via the answer map
    (unknown → 0), every other select → ``{field}_{option}`` 0/1 over the stored
    option list (sorted), so any submission yields the training columns."""
    out = [F.col(key)]
    for f in form:
        fid = f["id"]
        c = F.col(fid)
        if f["type"] == "number":
            out.append(c.try_cast("double").alias(fid))
        elif fid in FX.SCALED_FIELDS:
            out.append(scaled_answer(c).alias(fid))
        else:
            out += [F.coalesce((c == F.lit(o)).cast("int"), F.lit(0)).alias(f"{fid}_{o}") for o in sorted(f["options"])]
    return df.select(*out)


# ----------------------------------------------------------------- rule scorer

def _answer_int(fid: str) -> Column:
    """Leading integer of a 0–5 answer; an absent answer counts as 0."""
    c = F.col(fid)
    return F.when(c.isNull(), F.lit(0)).otherwise(leading_int(c))


def is_malformed(df_cols: list[str]) -> Column:
    """A submission the reference cannot process: a number field absent or not a
    number, or a present 0–5 answer without a leading integer."""
    bad = F.lit(False)
    for fid in FX.NUMBER_FIELDS:
        if fid in df_cols:
            bad = bad | F.col(fid).try_cast("double").isNull()
    for fid in ("Depression_Score", "Anxiety_Score", "Financial_Stress"):
        if fid in df_cols:
            bad = bad | _answer_int(fid).isNull()
    return bad


def risk_rule_score(df: DataFrame) -> Column:
    """struct(level, probability): dep ≥ 3 or anx ≥ 3 → High .75; ≥ 2 → Moderate .5; else Low .25."""
    dep, anx = _answer_int("Depression_Score"), _answer_int("Anxiety_Score")
    level = (F.when((dep >= 3) | (anx >= 3), F.lit("High"))
             .when((dep >= 2) | (anx >= 2), F.lit("Moderate")).otherwise(F.lit("Low")))
    prob = F.when(level == "High", F.lit(0.75)).when(level == "Moderate", F.lit(0.5)).otherwise(F.lit(0.25))
    return F.struct(level.alias("level"), prob.alias("probability"))


def recommendations(level: Column) -> Column:
    """Base list (4 for Low, 6 otherwise) + one line per flagged factor."""
    base = F.when(level == "Low", F.array(*[F.lit(x) for x in FX.BASE_RECS_LOW])).otherwise(
        F.array(*[F.lit(x) for x in FX.BASE_RECS_ELEVATED]))
    extra = F.array(
        F.when(F.col("Sleep_Quality") == "Poor", F.lit(FX.REC_POOR_SLEEP)),
        F.when(F.col("Physical_Activity") == "Low", F.lit(FX.REC_LOW_ACTIVITY)),
        F.when(F.col("Social_Support") == "Low", F.lit(FX.REC_LOW_SUPPORT)),
        F.when(_answer_int("Financial_Stress") >= 3, F.lit(FX.REC_FINANCIAL)))
    return F.concat(base, F.filter(extra, lambda x: x.isNotNull()))


def compose_response(level: Column, key: Column, seed: int = 42) -> Column:
    """Opening phrase by level + one phrase per known factor value + closing;
    choices indexed by hash(key, seed, slot)."""
    def pick(options: list[str], slot: str) -> Column:
        i = F.floor(hash_uniform(key, seed, slot) * len(options)).cast("int") + 1
        return F.element_at(F.array(*[F.lit(o) for o in options]), i)

    opening = F.when(level == "Low", pick(FX.OPENINGS["Low"], "open")) \
        .when(level == "Moderate", pick(FX.OPENINGS["Moderate"], "open")) \
        .otherwise(pick(FX.OPENINGS["High"], "open"))
    defaults = {"Sleep_Quality": "Average", "Physical_Activity": "Moderate", "Social_Support": "Moderate"}
    lines = []
    for factor, table in FX.FACTOR_PHRASES.items():
        val = F.coalesce(F.col(factor), F.lit(defaults[factor]))
        e = None
        for value, phrases in table.items():
            p = pick(phrases, factor)
            e = F.when(val == value, p) if e is None else e.when(val == value, p)
        lines.append(e)
    recs = F.filter(F.array(*lines), lambda x: x.isNotNull())
    closing = F.when(level == "Low", F.lit(FX.CLOSINGS["Low"])).when(
        level == "Moderate", F.lit(FX.CLOSINGS["Moderate"])).otherwise(F.lit(FX.CLOSINGS["High"]))
    body = F.concat_ws("", F.transform(recs, lambda r: F.concat(F.lit("- "), r, F.lit("\n"))))
    return F.concat(opening, F.lit("\n\nRecommendations:\n"), body, F.lit("\n"), closing)


def score_answers(df: DataFrame, key: str = "row_id", seed: int = 42) -> DataFrame:
    """The full reply per submission: stress_probability, stress_level, message,
    recommendations, is_fallback (malformed rows get the fixed fallback reply)."""
    bad = is_malformed(df.columns)
    rs = risk_rule_score(df)
    level = rs["level"]
    return df.select(
        key,
        F.when(bad, F.lit(0.5)).otherwise(rs["probability"]).alias("stress_probability"),
        F.when(bad, F.lit("Moderate")).otherwise(level).alias("stress_level"),
        F.when(bad, F.lit(FX.FALLBACK_MESSAGE)).otherwise(compose_response(level, F.col(key), seed)).alias("message"),
        F.when(bad, F.array(*[F.lit(x) for x in FX.FALLBACK_RECS])).otherwise(recommendations(level))
        .alias("recommendations"),
        bad.alias("is_fallback"))


# ---------------------------------------------------------------------- Viterbi

# Our own emission table for the event-stream binding (not from the reference):
# how likely each event type is under each hidden level.
EVENT_EMISSIONS = {
    "Low": {"view": 0.40, "click": 0.30, "purchase": 0.20, "signup": 0.08, "error": 0.02},
    "Moderate": {"view": 0.25, "click": 0.25, "signup": 0.20, "purchase": 0.15, "error": 0.15},
    "High": {"error": 0.50, "view": 0.20, "click": 0.15, "signup": 0.10, "purchase": 0.05},
}


def viterbi_decode(obs: DataFrame, key: str, order: list[str], symbol: str, states=FX.STATES,
                   trans=FX.TRANSITIONS, emis=EVENT_EMISSIONS, initial_from: str = "Low",
                   unknown: float = FX.UNKNOWN_EMISSION) -> DataFrame:
    """Most likely hidden-state path per key (log space).  Initial scores use the
    transition row of ``initial_from``; an unseen symbol has emission ``unknown``;
    ties go to the lexicographically largest state.

    Decoding is ``sequence.viterbi_states`` (segments of bounded size, whatever a
    key's length), which also gives the states one row per event; here a key's
    states are joined into one string.  Output: key, n_obs, log_prob, path."""
    from stratum.operators.sequence import viterbi_states

    per_event, scores = viterbi_states(obs, key, order, symbol, states, trans, emis, initial_from, unknown)
    path = per_event.groupBy(F.col(key).alias("_pk")).agg(
        F.array_sort(F.collect_list(F.struct(*order, "state"))).alias("_p"))
    t = scores.join(path, F.col(key).eqNullSafe(F.col("_pk")))
    return t.select(key, F.col("n_obs").cast("int").alias("n_obs"), "log_prob", F.concat_ws(",", F.col("_p.state")).alias("path"))

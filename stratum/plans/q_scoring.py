"""Queries for validation, scoring, recommendations, phrase composition,
sequence decoding and the streaming scorer (K)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from stratum.functions.hashing import hash_uniform_sql as H
from stratum.operators import form as FX
from stratum.operators import scoring as K
from stratum.plans.catalog import register
from stratum.session import scratch_path
from stratum.sources import bindings as bd
from stratum.streaming.score_stream import ANSWER_SCHEMA, flatten_reply, start_score_stream


def dl(x: float) -> str:
    """A double literal parsed as DOUBLE (not DECIMAL) by DuckDB."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def _lead(fid):
    return f"TRY_CAST(split_part({fid}, ' ', 1) AS INTEGER)"


def _ans(fid):
    return f"(CASE WHEN {fid} IS NULL THEN 0 ELSE {_lead(fid)} END)"


_BAD = " OR ".join([f"TRY_CAST({f} AS DOUBLE) IS NULL" for f in FX.NUMBER_FIELDS] +
                   [f"{_ans(f)} IS NULL" for f in ("Depression_Score", "Anxiety_Score", "Financial_Stress")])
_LEVEL = (f"CASE WHEN {_ans('Depression_Score')} >= 3 OR {_ans('Anxiety_Score')} >= 3 THEN 'High' "
          f"WHEN {_ans('Depression_Score')} >= 2 OR {_ans('Anxiety_Score')} >= 2 THEN 'Moderate' ELSE 'Low' END")
_RECS = (f"list_concat(CASE WHEN level = 'Low' THEN {lst(FX.BASE_RECS_LOW)} ELSE {lst(FX.BASE_RECS_ELEVATED)} END, "
         f"list_filter([CASE WHEN Sleep_Quality = 'Poor' THEN {q(FX.REC_POOR_SLEEP)} END, "
         f"CASE WHEN Physical_Activity = 'Low' THEN {q(FX.REC_LOW_ACTIVITY)} END, "
         f"CASE WHEN Social_Support = 'Low' THEN {q(FX.REC_LOW_SUPPORT)} END, "
         f"CASE WHEN {_ans('Financial_Stress')} >= 3 THEN {q(FX.REC_FINANCIAL)} END], lambda x: x IS NOT NULL))")


def _pick(options, slot):
    return f"({lst(options)})[CAST(floor({H('row_id', 42, q(slot))} * {len(options)}) AS INTEGER) + 1]"


def _message():
    opening = "CASE " + " ".join(f"WHEN level = {q(s)} THEN {_pick(FX.OPENINGS[s], 'open')}"
                                 for s in ("Low", "Moderate")) + f" ELSE {_pick(FX.OPENINGS['High'], 'open')} END"
    defaults = {"Sleep_Quality": "Average", "Physical_Activity": "Moderate", "Social_Support": "Moderate"}
    lines = []
    for factor, table in FX.FACTOR_PHRASES.items():
        val = f"coalesce({factor}, {q(defaults[factor])})"
        lines.append("CASE " + " ".join(f"WHEN {val} = {q(v)} THEN {_pick(p, factor)}" for v, p in table.items())
                     + " END")
    recs = f"list_filter([{', '.join(lines)}], lambda x: x IS NOT NULL)"
    closing = (f"CASE WHEN level = 'Low' THEN {q(FX.CLOSINGS['Low'])} WHEN level = 'Moderate' "
               f"THEN {q(FX.CLOSINGS['Moderate'])} ELSE {q(FX.CLOSINGS['High'])} END")
    body = f"array_to_string(list_transform({recs}, lambda r: '- ' || r || chr(10)), '')"
    return f"{opening} || chr(10) || chr(10) || 'Recommendations:' || chr(10) || {body} || chr(10) || {closing}"


_SCORED = f"""scored AS (
    SELECT *, CASE WHEN bad THEN 0.5 WHEN level = 'High' THEN 0.75 WHEN level = 'Moderate' THEN 0.5 ELSE 0.25 END
                  AS stress_probability,
              CASE WHEN bad THEN 'Moderate' ELSE level END AS stress_level,
              CASE WHEN bad THEN {q(FX.FALLBACK_MESSAGE)} ELSE {_message()} END AS message,
              CASE WHEN bad THEN {lst(FX.FALLBACK_RECS)} ELSE {_RECS} END AS recs
    FROM (SELECT *, coalesce({_BAD}, true) AS bad, {_LEVEL} AS level FROM answers))"""

_REPLY = """SELECT row_id, stress_probability, stress_level, message, CAST(len(recs) AS INTEGER) AS n_recommendations,
                   array_to_string(recs, ' | ') AS recommendations_text, bad AS is_fallback FROM scored"""


def _validate_sql():
    checks = []
    for f in FX.FORM:
        fid = f["id"]
        checks.append(f"CASE WHEN {fid} IS NULL OR trim({fid}) = '' THEN {q(fid + ': required')} END")
        if f["type"] == "number":
            checks.append(f"CASE WHEN {fid} IS NOT NULL AND trim({fid}) <> '' AND TRY_CAST({fid} AS DOUBLE) IS NULL "
                          f"THEN {q(fid + ': not a number')} END")
            checks.append(f"CASE WHEN TRY_CAST({fid} AS DOUBLE) < {float(f['min'])!r} "
                          f"THEN {q(fid + ': below ' + str(f['min']))} END")
            checks.append(f"CASE WHEN TRY_CAST({fid} AS DOUBLE) > {float(f['max'])!r} "
                          f"THEN {q(fid + ': above ' + str(f['max']))} END")
        else:
            opts = ", ".join(q(o) for o in f["options"])
            checks.append(f"CASE WHEN {fid} IS NOT NULL AND trim({fid}) <> '' AND {fid} NOT IN ({opts}) "
                          f"THEN {q(fid + ': invalid option')} END")
    v = f"list_filter([{', '.join(checks)}], lambda x: x IS NOT NULL)"
    return f"""SELECT row_id, CAST(len(v) AS INTEGER) AS n_violations, array_to_string(v, '; ') AS violations_text
               FROM (SELECT row_id, {v} AS v FROM answers)"""


@register("validate_answers", uses=("answers",), sql=_validate_sql())
def q_validate_answers(spark, sf):
    v = K.validate_answers(bd.answers(spark, sf))
    return v.select("row_id", "n_violations", F.concat_ws("; ", "violations").alias("violations_text"))


@register("violation_counts", uses=("answers",), sql=f"""
    SELECT violation, count(*) AS count FROM (SELECT unnest(v) AS violation FROM (
      {_validate_sql().replace('SELECT row_id, CAST(len(v) AS INTEGER) AS n_violations, array_to_string(v, ' + "'; '" + ') AS violations_text', 'SELECT v')}))
    GROUP BY violation""")
def q_violation_counts(spark, sf):
    return K.violation_counts(bd.answers(spark, sf))


def _assemble_sql():
    out = ["row_id"]
    for f in FX.FORM:
        fid = f["id"]
        if f["type"] == "number":
            out.append(f"TRY_CAST({fid} AS DOUBLE) AS {fid}")
        elif fid in FX.SCALED_FIELDS:
            whens = " ".join(f"WHEN {fid} = {q(v)} THEN {i}" for i, v in enumerate(FX.SCALE_0_5))
            out.append(f"CAST(coalesce(CASE {whens} END, 0) AS INTEGER) AS {fid}")
        else:
            out += [f"CAST(coalesce({fid} = {q(o)}, false) AS INTEGER) AS \"{fid}_{o}\"" for o in sorted(f["options"])]
    return "SELECT " + ", ".join(out) + " FROM answers"


@register("assemble_scoring_features", uses=("answers",), dbl=("Age", "CGPA", "Semester_Credit_Load"),
          sql=_assemble_sql())
def q_assemble_scoring_features(spark, sf):
    return K.assemble_scoring_features(bd.answers(spark, sf))


@register("risk_rule_score", uses=("answers",), dbl=("stress_probability",), ctes=_SCORED,
          sql="SELECT row_id, level AS stress_level, CASE WHEN level = 'High' THEN 0.75 WHEN level = 'Moderate' "
              "THEN 0.5 ELSE 0.25 END AS stress_probability FROM scored")
def q_risk_rule_score(spark, sf):
    a = bd.answers(spark, sf)
    rs = K.risk_rule_score(a)
    return a.select("row_id", rs["level"].alias("stress_level"), rs["probability"].alias("stress_probability"))


@register("recommendations", uses=("answers",), sql=f"""
    SELECT row_id, CAST(len(r) AS INTEGER) AS n_recommendations, array_to_string(r, ' | ') AS recommendations_text
    FROM (SELECT row_id, {_RECS} AS r FROM (SELECT *, {_LEVEL} AS level FROM answers))""")
def q_recommendations(spark, sf):
    a = bd.answers(spark, sf)
    r = K.recommendations(K.risk_rule_score(a)["level"])
    return a.select("row_id", F.size(r).alias("n_recommendations"),
                    F.concat_ws(" | ", r).alias("recommendations_text"))


@register("bad_record_fallback", uses=("answers",), dbl=("stress_probability",), ctes=_SCORED,
          sql="SELECT row_id, bad AS is_fallback, stress_level, stress_probability FROM scored")
def q_bad_record_fallback(spark, sf):
    s = K.score_answers(bd.answers(spark, sf))
    return s.select("row_id", "is_fallback", "stress_level", "stress_probability")


@register("compose_response", uses=("answers",), ctes=_SCORED, sql="SELECT row_id, message FROM scored")
def q_compose_response(spark, sf):
    return K.score_answers(bd.answers(spark, sf)).select("row_id", "message")


@register("score_answers", uses=("answers",), dbl=("stress_probability",), ctes=_SCORED, sql=_REPLY)
def q_score_answers(spark, sf):
    return flatten_reply(K.score_answers(bd.answers(spark, sf)))


@register("score_stream", uses=("answers",), dbl=("stress_probability",), ctes=_SCORED, sql=_REPLY)
def q_score_stream(spark, sf):
    """Submissions written as several parquet files → file-source stream
    (availableNow) → scored parquet sink; must equal the batch scorer."""
    src, sink, ck = (scratch_path(spark, n) for n in ("answers_in", "scored_out", "scored_ck"))
    bd.answers(spark, sf).select(*[F.col(f.name).cast(f.dataType) for f in ANSWER_SCHEMA.fields]) \
        .repartition(4).write.parquet(src)
    qy = start_score_stream(spark, src, sink, ck, available_now=True)
    qy.awaitTermination()
    return spark.read.parquet(sink)


# ---------------------------------------------------------------- Viterbi oracle

def _viterbi_sql():
    S = FX.STATES
    E = K.EVENT_EMISSIONS
    lt = [[math.log(FX.TRANSITIONS[a][b]) for b in S] for a in S]
    lunk = math.log(FX.UNKNOWN_EMISSION)

    def le(j, o):
        whens = " ".join(f"WHEN {q(sym)} THEN {dl(math.log(p))}" for sym, p in E[S[j]].items())
        return f"coalesce(CASE {o} {whens} END, {dl(lunk)})"

    base = ", ".join(f"{dl(math.log(FX.TRANSITIONS['Low'][s]))} + {le(j, 'o')} AS s{j}, {q(s)} AS p{j}"
                     for j, s in enumerate(S))
    bests = ", ".join(
        "list_sort([" + ", ".join(f"{{'v': v.s{i} + {dl(lt[i][j])}, 'n': {q(S[i])}, 'p': v.p{i}}}" for i in range(3))
        + f"], 'DESC')[1] AS b{j}" for j in range(3))
    nxt = ", ".join(f"b{j}.v + {le(j, 'o')} AS s{j}, b{j}.p || ',' || {q(S[j])} AS p{j}" for j in range(3))
    final = "list_sort([" + ", ".join(f"{{'v': s{i}, 'n': {q(S[i])}, 'p': p{i}}}" for i in range(3)) + "], 'DESC')[1]"
    return f"""WITH RECURSIVE
    seq AS (SELECT user_id, event_type AS o,
                   row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM obs),
    v AS (SELECT user_id, t, {base} FROM seq WHERE t = 1
          UNION ALL
          SELECT user_id, t, {nxt} FROM (
            SELECT v.user_id, v.t + 1 AS t, s.o, {bests}
            FROM v JOIN seq s ON s.user_id = v.user_id AND s.t = v.t + 1) x),
    last AS (SELECT * FROM v QUALIFY t = max(t) OVER (PARTITION BY user_id))
    SELECT user_id, CAST(t AS INTEGER) AS n_obs, fin.v AS log_prob, fin.p AS path
    FROM (SELECT user_id, t, {final} AS fin FROM last)"""


@register("viterbi_decode", uses=("obs",), dbl=("log_prob",), sql=_viterbi_sql())
def q_viterbi_decode(spark, sf):
    """Most likely Low/Moderate/High path per user over their ordered event types."""
    return K.viterbi_decode(bd.obs(spark, sf), "user_id", ["ts", "event_id"], "event_type")


@register("viterbi_scores_long", uses=("obs",), dbl=("log_prob",), sql=_viterbi_sql().replace(
    "SELECT user_id, CAST(t AS INTEGER) AS n_obs, fin.v AS log_prob, fin.p AS path",
    "SELECT user_id, CAST(t AS BIGINT) AS n_obs, fin.v AS log_prob"))
def q_viterbi_scores_long(spark, sf):
    """Per-user best log-probability."""
    from stratum.operators.sequence import viterbi_states

    _, scores = viterbi_states(bd.obs(spark, sf), "user_id", ["ts", "event_id"], "event_type")
    return scores.select("user_id", "n_obs", "log_prob")


@register("viterbi_states_long", uses=("obs",), sql=_viterbi_sql().replace(
    "SELECT user_id, CAST(t AS INTEGER) AS n_obs, fin.v AS log_prob, fin.p AS path",
    "SELECT s.user_id, s.ts, s.event_id, split_part(fin.p, ',', CAST(s.t AS INTEGER)) AS state").replace(
    "FROM (SELECT user_id, t, ", "FROM (SELECT user_id AS _u, t AS _t, ").replace(
    "FROM last)", "FROM last) f JOIN seq s ON s.user_id = f._u").replace(
    "SELECT user_id, event_type AS o,", "SELECT user_id, ts, event_id, event_type AS o,"))
def q_viterbi_states_long(spark, sf):
    """One decoded state per event."""
    from stratum.operators.sequence import viterbi_states

    states, _ = viterbi_states(bd.obs(spark, sf), "user_id", ["ts", "event_id"], "event_type")
    return states

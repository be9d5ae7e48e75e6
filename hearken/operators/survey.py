"""Survey export to coded features, with reports on what the coding loses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.functions import survey as code
from hearken.functions.fixed_values import (
    CHILD_KEYWORD,
    CODEBOOK,
    QUESTION_PREFIX,
    SCREENED_OUT,
    TENURE_ALERT_PCT,
    WEDDING_KEYWORD,
)
from hearken.functions.numeric import percent, round_even

VERBATIM = {
    "tenure_text": "q5", "situation_text": "q11_3", "worry_text": "q13_1",
    "pricing_text": "q13_2", "channel": "q15",
}


def column_of(headers: list[str], question: str) -> str:
    """The one header that starts with the number of the question."""
    prefix = QUESTION_PREFIX[question]
    found = [h for h in headers if h.strip().startswith(prefix)]
    if len(found) != 1:
        raise KeyError(f"question {prefix} needs one column, found {found}")
    return found[0]


def with_question_names(raw: DataFrame) -> DataFrame:
    """Rename full-text headers to question ids; only the verbatim questions may be absent."""
    optional = set(VERBATIM.values()) - {"q5"}
    names = {}
    for question, prefix in QUESTION_PREFIX.items():
        absent = not any(h.strip().startswith(prefix) for h in raw.columns)
        if not (absent and question in optional):
            names[column_of(raw.columns, question)] = question
    return raw.withColumnsRenamed(names)


def without_screened_out(raw: DataFrame) -> DataFrame:
    """Drop respondents who own no device; people who gave no answer stay."""
    return raw.filter(~F.col("q1").eqNullSafe(F.lit(SCREENED_OUT)))


def encode(raw: DataFrame, keep: tuple[str, ...] = ("respondent_id",)) -> DataFrame:
    """All fourteen features and the verbatim answers in one projection."""
    a = F.col
    features = {
        "devices_owned": code.coded(a("q1"), CODEBOOK["q1"]),
        "app_frequency": code.coded(a("q2"), CODEBOOK["q2"]),
        "age_band": code.coded(a("q3"), CODEBOOK["q3"]),
        "has_child": code.has_keyword(a("q4"), CHILD_KEYWORD),
        "is_renter": code.coded(a("q5"), CODEBOOK["q5"]),
        "move_plan": code.coded(a("q6"), CODEBOOK["q6"]),
        "wedding_purchase": code.has_keyword(a("q7"), WEDDING_KEYWORD),
        "p1_experience": code.leading_scale(a("q8")),
        "p2_experience": code.leading_scale(a("q9")),
        "p3_burden": code.leading_scale(a("q10")),
        "owns_watch": code.picked_any(a("q11_1")),
        "night_use": code.leading_scale(a("q11_2")),
        "onbody_intent": code.leading_scale(a("q12")),
        "pay_intent": code.coded(a("q13"), CODEBOOK["q13"]),
    }
    verbatim = {n: a(q) for n, q in VERBATIM.items() if q in raw.columns}
    return raw.select(
        *keep,
        *[c.cast("double").alias(n) for n, c in features.items()],
        *[c.alias(n) for n, c in verbatim.items()],
    )


def unknown_answers(raw: DataFrame, questions: tuple[str, ...] = ("q1", "q2", "q3", "q6", "q13")) -> DataFrame:
    """Answers the codebook does not know, with their counts; they are coded as NULL."""
    pairs = ", ".join(f"'{q}', {q}" for q in questions)
    long = raw.selectExpr(f"stack({len(questions)}, {pairs}) as (question, answer)")
    known = F.lit(False)
    for q in questions:
        known = known | ((F.col("question") == q) & F.col("answer").isin(list(CODEBOOK[q])))
    lost = long.filter(F.col("answer").isNotNull() & ~known)
    return lost.groupBy("question", "answer").agg(F.count(F.lit(1)).alias("n"))


def tenure_loss(raw: DataFrame) -> DataFrame:
    """Free-text tenure answers outside own/rent: count, share of all, alert from 20 %."""
    total = raw.agg(F.count(F.lit(1))).scalar()
    answer = F.trim("q5")
    lost = raw.filter(F.col("q5").isNotNull() & ~F.col("q5").isin(list(CODEBOOK["q5"])))
    per_answer = lost.groupBy(answer.alias("answer")).agg(F.count(F.lit(1)).alias("n"))
    n_lost = per_answer.agg(F.sum("n")).scalar()
    return per_answer.withColumns(
        {
            "lost_n": n_lost,
            "lost_pct": percent(n_lost, total),
            "alert": n_lost / total * F.lit(100.0) >= F.lit(TENURE_ALERT_PCT),
        }
    )


def missing_cells(df: DataFrame, features: list[str]) -> DataFrame:
    """NULL cells over the features, in total."""
    cells = [F.count_if(F.col(c).isNull()) for c in features]
    total = cells[0]
    for c in cells[1:]:
        total = total + c
    return df.agg(total.alias("missing_cells"))


def crosstab_intent(members: DataFrame) -> DataFrame:
    """Mean intent by move plan and tenure, and whether the cell is purely synthetic."""
    return members.groupBy("move_plan", "is_renter").agg(
        round_even(F.avg("onbody_intent"), 2).alias("avg_intent"),
        F.count(F.lit(1)).alias("n"),
        F.every(F.col("source_type") == "synthetic_demo").alias("all_synthetic"),
    )


def correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return df.agg(*[round_even(F.corr(a, b), 6).alias(f"{a}__{b}") for a, b in pairs])

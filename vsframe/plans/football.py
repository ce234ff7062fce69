"""The reference's four questions over match results and goal scorers.

Inputs are the two CSV files (``results``: one row per match; ``goalscorers``:
one row per goal), loaded leniently. Each question is a thin composition of
the operators and returns the reference's column names. Where the reference
left an order or a tie undefined, a total order is added (see README).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vsframe.functions.scalar import pair_label, period_predicate
from vsframe.operators import (
    alias_filter,
    count_per_group,
    event_gaps,
    extremes,
    from_period,
    longest_gaps,
    member_set,
    mode_per_group,
    net_by_counterparty,
    repeated_in_group,
    restrict_to_members,
    top_n_per_group,
    two_sided_to_long,
)
from vsframe.sources import read_typed_csv

# Fixed values that must equal the reference's for the same results:
# tournament aliases (compared lower-cased), the World Cup label and member
# tournament, the default subject team, the Q4 date floor, the Q1 labels, the
# output column names of each question (in output order) and the result
# folder names.
EURO_ALIASES = ("uefa euro", "uefa european championship", "european championship")
WORLD_CUP_ALIASES = ("fifa world cup", "world cup")
WORLD_CUP = "FIFA World Cup"
DEFAULT_TEAM = "Serbia"
UNBEATEN_SINCE = "1980-01-01"
Q1_LABELS = ("Najbolja", "Najgora")
Q1_COLUMNS = ("Protivnik", "Gol razlika", "Najbolja / Najgora")
Q2_COLUMNS = ("Datum", "Domacin", "Gost", "Rezultat", "Strelac", "Ukupno golova", "Turnir", "Drzava")
Q3_COLUMNS = ("Strelac", "Reprezentacija", "Broj golova", "Rang", "Godina", "Turnir", "Drzava")
Q4_COLUMNS = ("Reprezentacija", "Poraz od", "Poraz datum", "Prethodni poraz od", "Prethodni poraz datum", "Period-dana")
OUTPUT_NAMES = ("q1_serbia_best_worst", "q2_euro_hat_tricks", "q3_wc_top_scorers", "q4_longest_unbeaten")

MATCH_KEYS = ["date", "home_team", "away_team"]
RESULTS_TYPES = {"date": "date", "home_score": "int", "away_score": "int"}
GOALS_TYPES = {"date": "date", "minute": "int"}


def _named(df: DataFrame, columns, names) -> DataFrame:
    """Select ``columns`` renamed to the output ``names``, in that order."""
    return df.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])


def load_results(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """Matches: typed date and scores, ``neutral`` as a non-null boolean, rest text."""
    return read_typed_csv(spark, path, RESULTS_TYPES, ["neutral"], multi_line=multi_line)


def load_goalscorers(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """Goals: typed date and minute, rest text."""
    return read_typed_csv(spark, path, GOALS_TYPES, multi_line=multi_line)


def best_worst_opponent(results: DataFrame, team: str = DEFAULT_TEAM) -> DataFrame:
    """Q1: the opponent with the best and the worst total goal difference for ``team``."""
    balance = net_by_counterparty(
        results, team, "home_team", "away_team", "home_score", "away_score",
        counterparty="opponent", measure="goal_diff",
    )
    best_worst = extremes(balance, "opponent", "goal_diff", labels=Q1_LABELS)
    return _named(best_worst, ["opponent", "goal_diff", "kind"], Q1_COLUMNS)


def hat_tricks(
    results: DataFrame,
    goals: DataFrame,
    *,
    aliases=EURO_ALIASES,
    min_goals: int = 3,
    fact_filter=None,
) -> DataFrame:
    """Q2: scorers with at least ``min_goals`` goals in one match of the tournament."""
    matches = alias_filter(results, "tournament", aliases).select(
        *MATCH_KEYS, "home_score", "away_score", "tournament", "country"
    )
    repeats = repeated_in_group(
        goals, [*MATCH_KEYS, "scorer"], min_count=min_goals, count_col="goals", fact_filter=fact_filter
    )
    joined = repeats.join(matches, on=MATCH_KEYS).withColumn("score", pair_label("home_score", "away_score"))
    ordered = joined.orderBy("date", "home_team", "away_team", "scorer")
    return _named(
        ordered, ["date", "home_team", "away_team", "score", "scorer", "goals", "tournament", "country"], Q2_COLUMNS
    )


def top_scorers(
    results: DataFrame,
    goals: DataFrame,
    *,
    from_year: int = 1990,
    aliases=WORLD_CUP_ALIASES,
    n: int = 2,
    ties: str = "named",
    host_ties: str = "named",
    label: str = WORLD_CUP,
) -> DataFrame:
    """Q3: the first ``n`` scorers of each tournament year since ``from_year``, with the host."""
    matches = from_period(alias_filter(results, "tournament", aliases), "date", from_year=from_year).select(
        *MATCH_KEYS, "country", F.year("date").alias("year")
    )
    hosts = mode_per_group(matches, ["year"], "country", ties=host_ties, out_col="country").select("year", "country")
    scored = count_per_group(goals.join(matches.select(*MATCH_KEYS, "year"), on=MATCH_KEYS), ["year", "scorer", "team"], "goals")
    ranked = top_n_per_group(scored, ["year"], "goals", "scorer", n=n, ties=ties, rank_col="rank")
    joined = ranked.withColumn("tournament", F.lit(label)).join(hosts, on="year", how="left")
    ordered = joined.orderBy("year", F.col("goals").desc(), "scorer", "team")
    return _named(ordered, ["scorer", "team", "goals", "rank", "year", "tournament", "country"], Q3_COLUMNS)


def longest_unbeaten(
    results: DataFrame,
    *,
    since: str = UNBEATEN_SINCE,
    n: int = 20,
    member_tournament: str = WORLD_CUP,
    per_entity: bool = False,
    open_end: str | None = None,
    strategy: str = "bucket",
    collapse_copies: bool = False,
    rows_per_salt: int | None = 2_000_000,
) -> DataFrame:
    """Q4: the ``n`` longest spans between consecutive losses of a World Cup team.

    Spans are calendar days between two losses dated on or after ``since``;
    members are teams that played any match whose tournament equals
    ``member_tournament`` exactly. Same-day losses are ordered by opponent;
    the cut at ``n`` follows (days desc, team, date, opponent, previous date,
    previous opponent), a total order up to identical rows.
    ``open_end`` also counts each team's run still unbeaten at that date (its
    row has a null loss opponent). ``collapse_copies`` handles heavily
    duplicated match rows without a hot partition (see ``event_gaps``);
    teams with more than ``rows_per_salt`` losses are salted in the membership
    join (see ``restrict_to_members``).
    """
    members = member_set(
        results, ["home_team", "away_team"], name="team", where=F.col("tournament") == F.lit(member_tournament)
    )
    sides = two_sided_to_long(
        results,
        ["date"],
        {"team": "home_team", "opponent": "away_team", "gf": "home_score", "ga": "away_score"},
        {"team": "away_team", "opponent": "home_team", "gf": "away_score", "ga": "home_score"},
    )
    # losses since the floor first (restriction is per team, so the order
    # commutes), so the membership join and its key count see only them
    losses = sides.where(
        period_predicate("date", T.DateType(), from_date=since) & (F.col("ga") > F.col("gf"))
    ).select("team", "date", "opponent")
    gaps = event_gaps(
        restrict_to_members(losses, members, "team", rows_per_salt=rows_per_salt),
        "team",
        "date",
        order=["opponent"],
        carry=["opponent"],
        bucket=F.trunc("date", "year"),  # a team loses a few times a year
        open_end=open_end,
        strategy=strategy,
        collapse_copies=collapse_copies,
    )
    top = longest_gaps(
        gaps, n=n, order=["team", "date", "opponent", "prev_date", "prev_opponent"], entity="team", per_entity=per_entity
    )
    return _named(top, ["team", "opponent", "date", "prev_opponent", "prev_date", "gap_days"], Q4_COLUMNS)


def answer_all(results: DataFrame, goals: DataFrame) -> dict[str, DataFrame]:
    """The four questions with their default parameters, keyed by result folder name."""
    return dict(
        zip(
            OUTPUT_NAMES,
            (
                best_worst_opponent(results),
                hat_tricks(results, goals),
                top_scorers(results, goals),
                longest_unbeaten(results),
            ),
        )
    )


# Answers whose size is bounded by construction (2 rows; n per year; top n),
# written as a single file. The hat-trick list grows with the data, so it is
# written by all tasks as ordered part files instead of through one writer.
_SINGLE_FILE = {"q1_serbia_best_worst", "q3_wc_top_scorers", "q4_longest_unbeaten"}


def save_all(results: DataFrame, goals: DataFrame, out_dir: str) -> list[str]:
    """Write each answer as headed CSV under ``out_dir/<name>``."""
    from vsframe.sources import write_csv

    paths = []
    for name, df in answer_all(results, goals).items():
        path = f"{out_dir.rstrip('/')}/{name}"
        write_csv(df, path, single_file=name in _SINGLE_FILE)
        paths.append(path)
    return paths


def main(argv: list[str] | None = None) -> None:
    """``python -m vsframe.plans.football --results R --goals G --out DIR``."""
    import argparse

    from vsframe.session import RECOMMENDED_CONF

    parser = argparse.ArgumentParser(description="Answer the four football questions with Spark.")
    parser.add_argument("--results", required=True, help="matches CSV")
    parser.add_argument("--goals", required=True, help="goal scorers CSV")
    parser.add_argument("--out", required=True, help="output folder (one sub-folder per question)")
    args = parser.parse_args(argv)
    builder = SparkSession.builder.appName("vsframe-football")
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    for path in save_all(load_results(spark, args.results), load_goalscorers(spark, args.goals), args.out):
        print(path)


if __name__ == "__main__":
    main()

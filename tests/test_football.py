"""The four reference questions over the hand-made scenario (tests/fixtures).

Expected rows were worked out by hand from the fixture; each block names the
"""

import datetime as dt

import pytest

from vsframe.plans import football as fb

D = dt.date


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_loaders_type_leniently(results, goals):
    types = dict(results.dtypes)
    assert types["date"] == "date" and types["home_score"] == "int" and types["neutral"] == "boolean"
    assert types["tournament"] == "string" and types["city"] == "string"
    assert dict(goals.dtypes)["minute"] == "int"
    # NA score, NA minute and malformed dates become null instead of failing
    assert results.where("home_score is null").count() == 3
    assert results.where("date is null").count() == 1
    assert goals.where("minute is null").count() == 1
    assert goals.where("date is null").count() == 1
    # TRUE, t, yes, 1 are true; FALSE, f, no, 0, other, empty are false
    by_date = {r["date"]: r["neutral"] for r in results.where("home_team = 'Serbia' or away_team = 'Serbia'").collect()}
    assert by_date[D(2001, 4, 1)] is False  # "f"
    assert by_date[D(2001, 6, 1)] is False  # empty
    assert by_date[D(2001, 7, 1)] is False  # "other"
    flags = {(r["home_team"], r["away_team"]): r["neutral"] for r in results.where("date = '2008-06-10'").collect()}
    assert flags == {("Spain", "Russia"): True, ("Germany", "Poland"): True}  # "t", "yes"
    assert results.where("neutral is null").count() == 0


def test_csv_text_with_comma_quote_newline(results, goals):
    # Quoted comma, doubled quote and newline survive the read
    row = results.where("date = '2005-05-05'").first()
    assert row["home_team"] == "Korea, South"
    assert row["away_team"] == 'Trinidad "and" Tobago'
    assert row["city"] == "Port of\nSpain"
    assert goals.where("team = 'Korea, South'").count() == 1


def test_q1_best_and_worst(results):
    out = fb.best_worst_opponent(results)
    assert out.columns == ["Protivnik", "Gol razlika", "Najbolja / Najgora"]
    # Null-score match ignored; T3: all-null opponent (Denmark) dropped;
    # T5: Albania and Bosnia tie on +3, the smaller name wins
    assert rows(out) == [("Albania", 3, "Najbolja"), ("Croatia", -2, "Najgora")]
    assert dict(out.dtypes)["Gol razlika"] == "bigint"


def test_q1_one_opponent_and_none(results):
    # One opponent is both best and worst; T4/S6: no opponent, no rows, same schema
    two = fb.best_worst_opponent(results, "Zaire")
    assert rows(two) == [("Haiti", -1, "Najbolja"), ("Ghana", -2, "Najgora")]
    only = fb.best_worst_opponent(results, "Estonia")
    assert rows(only) == [("Serbia", 0, "Najbolja"), ("Serbia", 0, "Najgora")]
    none = fb.best_worst_opponent(results, "Atlantis")
    assert rows(none) == [] and none.columns == only.columns and none.dtypes == only.dtypes


def test_q2_hat_tricks(results, goals):
    out = fb.hat_tricks(results, goals)
    assert out.columns == ["Datum", "Domacin", "Gost", "Rezultat", "Strelac", "Ukupno golova", "Turnir", "Drzava"]
    expected = [
        # Namesakes on both sides merge into one group of 3
        (D(1976, 6, 17), "Yugoslavia", "Germany", "2:4", "Müller", 3, "UEFA Euro", "Yugoslavia"),
        # null scorer's 2 goals are a group of their own, below the threshold
        (D(1984, 6, 16), "France", "Belgium", "5:0", "Michel Platini", 3, "UEFA Euro", "France"),
        # A null home score is skipped by the label
        (D(1988, 6, 15), "England", "Netherlands", "3", "Marco van Basten", 3, "UEFA European Championship", "Germany"),
        # The duplicated match row doubles the result row
        (D(2000, 6, 20), "Portugal", "Germany", "3:0", "Sérgio Conceição", 3, "UEFA Euro", "Netherlands"),
        (D(2000, 6, 20), "Portugal", "Germany", "3:0", "Sérgio Conceição", 3, "UEFA Euro", "Netherlands"),
        # lower-case tournament matches; 4 goals count as at least 3
        (D(2000, 6, 25), "Netherlands", "Yugoslavia", "6:1", "Patrick Kluivert", 4, "uefa euro", "Netherlands"),
        # Same date, ordered by home team
        (D(2008, 6, 10), "Germany", "Poland", "3:0", "Lukas Podolski", 3, "UEFA Euro", "Austria"),
        (D(2008, 6, 10), "Spain", "Russia", "4:1", "David Villa", 3, "UEFA Euro", "Austria"),
    ]
    # "UEFA Euro qualification" (Zidane) does not match; the NA-dated goal does not join
    assert rows(out) == expected


def test_q2_fact_filter_option(results, goals):
    # T7 option: exclude own goals -> Müller's merged group drops to 2
    out = fb.hat_tricks(results, goals, fact_filter="own_goal != 'TRUE'")
    assert "Müller" not in [r["Strelac"] for r in out.collect()]


def test_q3_top_scorers_named(results, goals):
    out = fb.top_scorers(results, goals)
    assert out.columns == ["Strelac", "Reprezentacija", "Broj golova", "Rang", "Godina", "Turnir", "Drzava"]
    assert rows(out) == [
        ("Tomáš Skuhravý", "Czechoslovakia", 3, 1, 1990, "FIFA World Cup", "Italy"),
        ("Salvatore Schillaci", "Italy", 2, 2, 1990, "FIFA World Cup", "Italy"),
        # Three tied on 2 goals, cut by name; T13: hosts tie, first by name
        ("Kennet Andersson", "Sweden", 2, 1, 1994, "FIFA World Cup", "Canada"),
        ("Roger Milla", "Cameroon", 2, 2, 1994, "FIFA World Cup", "Canada"),
        # The same name in two teams is two groups sharing rank 1 -> three
        # rows; alias "World Cup" counts
        ("Ronaldo", "Brazil", 2, 1, 1998, "FIFA World Cup", "France"),
        ("Ronaldo", "Portugal", 2, 1, 1998, "FIFA World Cup", "France"),
        ("César Sampaio", "Brazil", 1, 2, 1998, "FIFA World Cup", "France"),
        # Null country wins the host count -> empty host; qualification excluded;
        # Lower-case "fifa world cup" match counts, label stays constant
        ("Emmanuel Sanon", "Haiti", 1, 1, 2002, "FIFA World Cup", ""),
        ("Hwang Sun-hong", "Korea", 1, 2, 2002, "FIFA World Cup", ""),
    ]


def test_q3_tie_options(results, goals):
    dense = fb.top_scorers(results, goals, ties="dense", host_ties="all")
    y1994 = [r for r in rows(dense) if r[4] == 1994]
    assert sorted(y1994) == sorted([
        ("Kennet Andersson", "Sweden", 2, 1, 1994, "FIFA World Cup", "Canada/United States"),
        ("Roger Milla", "Cameroon", 2, 1, 1994, "FIFA World Cup", "Canada/United States"),
        ("Romário", "Brazil", 2, 1, 1994, "FIFA World Cup", "Canada/United States"),
        ("Jürgen Klinsmann", "Germany", 1, 2, 1994, "FIFA World Cup", "Canada/United States"),
    ])
    # named top-N is a subset of dense top-N (same year, scorer, team)
    named = {(r[0], r[1], r[4]) for r in rows(fb.top_scorers(results, goals))}
    assert named <= {(r[0], r[1], r[4]) for r in rows(dense)}


EXPECTED_Q4 = [
    ("Russia", "Japan", D(2002, 6, 4), "Brazil", D(1994, 6, 20), 2906),
    # The loss dated exactly 1980-01-01 is kept; T16: only a draw inside
    ("Peru", "Colombia", D(1986, 2, 2), "Colombia", D(1980, 1, 1), 2224),
    ("Poland", "Germany", D(2008, 6, 10), "Korea", D(2002, 6, 2), 2200),
    # One team with two gaps
    ("Russia", "Spain", D(2008, 6, 10), "Japan", D(2002, 6, 4), 2198),
    # Draw and null-score match inside the gap; T17/T18: the 1979 loss and
    # the open run after 1990 are not gaps
    ("Chile", "Peru", D(1990, 1, 1), "Bolivia", D(1985, 7, 7), 1639),
    ("Chile", "Bolivia", D(1985, 7, 7), "Uruguay", D(1981, 3, 1), 1589),
    ("United States", "Italy", D(1990, 6, 14), "Czechoslovakia", D(1990, 6, 10), 4),
    # Duplicated match gives a zero-day gap; T23: same-day losses ordered by opponent
    ("Germany", "Portugal", D(2000, 6, 20), "Portugal", D(2000, 6, 20), 0),
    ("Peru", "Ecuador", D(1986, 2, 2), "Colombia", D(1986, 2, 2), 0),
]


@pytest.mark.parametrize(
    "strategy,collapse,per_salt", [("bucket", False, 2_000_000), ("window", False, None), ("bucket", True, 1)]
)
def test_q4_longest_unbeaten(results, strategy, collapse, per_salt):
    out = fb.longest_unbeaten(results, strategy=strategy, collapse_copies=collapse, rows_per_salt=per_salt)
    assert out.columns == [
        "Reprezentacija", "Poraz od", "Poraz datum", "Prethodni poraz od", "Prethodni poraz datum", "Period-dana",
    ]
    # Zaire only played a lower-case "fifa world cup" match: not a member
    assert rows(out) == EXPECTED_Q4


def test_q4_cut_and_per_team(results):
    # The cut at a tie is decided by (team, date, opponent)
    assert rows(fb.longest_unbeaten(results, n=8)) == EXPECTED_Q4[:8]
    # T20 option: one row per team
    per_team = rows(fb.longest_unbeaten(results, per_entity=True))
    assert [r[0] for r in per_team] == ["Russia", "Peru", "Poland", "Chile", "United States", "Germany"]


def test_golden_invariants(results, goals):
    """FIXTURES.md section 2 invariants, checked on our scenario output."""
    q1 = rows(fb.best_worst_opponent(results))
    assert [r[2] for r in q1] == ["Najbolja", "Najgora"] and q1[0][1] >= q1[1][1]
    q2 = rows(fb.hat_tricks(results, goals))
    assert all(r[5] >= 3 for r in q2)
    assert [r[0] for r in q2] == sorted(r[0] for r in q2)
    assert all(":" in r[3] or r[3].isdigit() for r in q2)
    q3 = rows(fb.top_scorers(results, goals))
    assert all(r[3] in (1, 2) for r in q3)
    assert [(r[4], -r[2]) for r in q3] == sorted((r[4], -r[2]) for r in q3)
    q4 = rows(fb.longest_unbeaten(results))
    assert all((r[2] - r[4]).days == r[5] for r in q4)
    assert [r[5] for r in q4] == sorted((r[5] for r in q4), reverse=True)
    assert all(r[2] >= D(1980, 1, 1) and r[4] >= D(1980, 1, 1) for r in q4)


def test_q4_open_end_option(results):
    # T17 option: runs still unbeaten at the as-of date count too
    # (a team whose last loss is after the as-of date has no open run)
    out = rows(fb.longest_unbeaten(results, n=3, open_end="2000-01-01"))
    assert out == [
        ("Belgium", None, D(2000, 1, 1), "France", D(1984, 6, 16), 5677),
        ("Peru", None, D(2000, 1, 1), "Ecuador", D(1986, 2, 2), 5081),
        ("Chile", None, D(2000, 1, 1), "Peru", D(1990, 1, 1), 3652),
    ]


def test_save_all_writes_one_csv_per_question(spark, results, goals):
    import glob
    import os

    from vsframe import shared_dir
    from vsframe.sources import read_typed_csv

    out = shared_dir(spark, "football-out")
    paths = fb.save_all(results, goals, out)
    assert [p.rsplit("/", 1)[1] for p in paths] == list(fb.OUTPUT_NAMES)
    q1 = read_typed_csv(spark, paths[0], {"Gol razlika": "bigint"})
    assert q1.columns == ["Protivnik", "Gol razlika", "Najbolja / Najgora"]
    assert sorted(tuple(r) for r in q1.collect()) == [("Albania", 3, "Najbolja"), ("Croatia", -2, "Najgora")]
    q4 = read_typed_csv(spark, paths[3], {"Period-dana": "int"})
    assert q4.count() == len(EXPECTED_Q4)
    assert read_typed_csv(spark, paths[1]).count() == 8  # hat-tricks: ordered part files
    local = paths[0].replace("file:", "")
    if os.path.isdir(local):
        assert len(glob.glob(os.path.join(local, "part-*.csv"))) == 1


def test_cli_main_writes_every_answer(spark, capsys):
    import os

    from vsframe import shared_dir

    out = shared_dir(spark, "football-cli")
    fixtures = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")
    fb.main(["--results", os.path.join(fixtures, "results.csv"), "--goals", os.path.join(fixtures, "goalscorers.csv"),
             "--out", out])
    printed = capsys.readouterr().out.split()
    assert [p.rsplit("/", 1)[1] for p in printed] == list(fb.OUTPUT_NAMES)
    assert spark.read.option("header", True).csv(printed[2]).count() == 9  # Q3 rows of the scenario


def test_answers_do_not_depend_on_session_time_zone(spark, results, goals):
    import __spark_entry__ as entry
    from conftest import SF001

    key = "spark.sql.session.timeZone"
    old = spark.conf.get(key)

    def snapshot():
        got = [sorted(map(tuple, q.collect()), key=repr) for q in fb.answer_all(results, goals).values()]
        for name in ("event_gaps", "deficit_gaps_top20"):
            got.append(sorted(map(tuple, entry.queries()[name](spark, SF001).collect()), key=repr))
        return got

    try:
        base = snapshot()
        for tz in ("Pacific/Kiritimati", "America/Los_Angeles"):
            spark.conf.set(key, tz)
            assert snapshot() == base, tz
    finally:
        spark.conf.set(key, old)

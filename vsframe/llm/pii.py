"""Personal data in texts: base patterns, and weakly supervised further spans.

DataFrame functions only. Four base patterns always count. Further candidates,
runs of letters and digits that look like codes or numbers, are voted on by
four labelers: a regular expression for known shapes, a gazetteer of words just
before, the punctuation around, and the mix of characters. Each votes yes, no
or abstains. Expectation-maximisation over the counts of vote patterns (at most
3 ** 4 rows, whatever the input) estimates how far each labeler is to be trusted;
its posteriors are the soft labels on which the final span classifier, naive
Bayes over the candidates' own features, is trained. Candidates that it accepts
are added, unless they overlap a base span.

Offsets are in code points, ends exclusive. A null text is empty; repeated rows
are each reported. With no candidate at all nothing is learned or added. The
time for a text is in proportion to its length, however many matches it has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vsframe.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns. Possessive and bound to the start of a run, which
#: changes no match: a run that fails from its start fails from everywhere. So
#: does a run of fewer digits than a card has, which is no match here.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without this character have no match; spares the search.
MARKS = {"email": "@", "ip": ".", "phone": "+"}
#: A telephone number with brackets, or a run of at least 8 letters and digits.
CANDIDATE = (
    r"(?<![A-Za-z0-9])(?:[0-9]{1,3} ?\([0-9]{2,4}\) ?[0-9]{3}[ -]?[0-9]{4}(?![0-9])"
    r"|(?=[A-Za-z0-9]{8})[A-Za-z]*+[0-9][A-Za-z0-9]*+)"
)
#: Code points before a candidate that labelers read.
CONTEXT = 24

# Gazetteers: words that announce personal data or a secret, and that do not.
YES_WORDS = (
    "password|passwd|passwort|contraseña|mot de passe|pwd|token|secret|api[_ -]?key|apikey|access[_ -]?key|auth|bearer"
    "|credential|private key|ssn|social security|passport|iban|account|card|visa|phone|tel|mobile|fax|call|born|user|login"
)
NO_WORDS = "version|license|licence|copyright|isbn|issn|page|chapter|section|figure|table|vol|no\\.|step|commit|sha256|md5"
# Shapes of well-known secrets.
SHAPES = (
    r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|(?=.*[a-f])(?=.*[0-9])[0-9a-f]{16,}|gh[pousr][A-Za-z0-9]{30,}|AIza[A-Za-z0-9]{30,}"
    r"|sk[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9]{10,})$"
)
LABELERS = ("shape", "gazetteer", "context", "mix")
EM_ROUNDS = 25
#: Posterior from which a candidate counts.
THRESHOLD = 0.5


#: Values of one block of a running total, and levels of blocks; at the top are
#: n / 32**3 values, whose square stays below n for any text that fits a row.
_BLOCK, _LEVELS = 32, 3


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, combine: Callable[[Column, Column], Column], zero: Column, levels: int = _LEVELS) -> Column:
    """array: element i combines elements 0..i of an array of integers.

    Blocks of a few values each are combined on their own, then the blocks'
    totals in the same way, so that time stays in proportion to the length.
    """

    def all_of(part: Column) -> Column:
        return F.aggregate(part, zero, lambda a, b: combine(a, b))

    def short(part: Column) -> Column:
        return F.transform(part, lambda _, i: all_of(F.slice(part, F.lit(1), i + 1)))

    def whole(all_: Column) -> Column:
        n = F.size(all_)
        starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(_BLOCK))).otherwise(F.array().cast("array<int>"))
        return _bind(F.transform(starts, lambda at: F.slice(all_, at, F.lit(_BLOCK))), joined)

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, all_of)
        return _bind(
            running(totals, combine, zero, levels - 1),
            lambda before: F.flatten(
                F.transform(
                    parts, lambda p, k: F.transform(short(p), lambda x: combine(x, F.when(k > 0, before[k - 1]).otherwise(zero)))
                )
            ),
        )

    return _bind(values, whole if levels else short)


def _offsets(found: str, parts: str) -> Column:
    """array<(start, end, match, before, after)> of matches and the pieces
    between them, which alternate."""
    steps = F.transform(found, lambda m, i: F.char_length(F.col(parts)[i]) + F.char_length(m))

    def spans(ends: Column) -> Column:
        return F.transform(
            found,
            lambda m, i: F.struct(
                (ends[i] - F.char_length(m)).alias("start"),
                ends[i].alias("end"),
                m.alias("match"),
                F.right(F.col(parts)[i], F.lit(CONTEXT)).alias("before"),
                F.left(F.col(parts)[i + 1], F.lit(1)).alias("after"),
            ),
        )

    return _bind(running(steps, lambda a, b: a + b, F.lit(0)), spans)


def locate(docs: DataFrame, name: str, pattern: str, mark: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``name``: the spans where ``pattern`` matches.

    Splitting at the pattern gives the pieces between the matches, and with
    their lengths the offsets.
    """
    text = F.coalesce(text_col, F.lit(""))
    some = F.lit(True) if mark is None else F.contains(text, F.lit(mark))
    none = F.array().cast("array<string>")
    split = docs.withColumns(
        {
            "_f": F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
            "_p": F.when(some, F.split(text, pattern, -1)).otherwise(none),
        }
    )
    return split.withColumn(name, _offsets("_f", "_p")).drop("_f", "_p")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, span: Column) -> Column:
    match = span["match"]
    digits = _digits(match)
    if kind == "ip":
        return match.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:\.|$)){4}")
    if kind == "card":
        return F.char_length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.char_length(digits).between(10, 15)
    return F.lit(True)


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base``: array<(start, rank, kind, end)>, sorted."""
    for kind in KINDS:
        docs = locate(docs, f"_{kind}", PATTERNS[kind], MARKS.get(kind), text_col)
    each = [_valid_spans(kind, rank) for rank, kind in enumerate(KINDS)]
    return docs.withColumn("base", F.array_sort(F.concat(*each))).drop(*(f"_{kind}" for kind in KINDS))


def _valid_spans(kind: str, rank: int) -> Column:
    valid = F.filter(f"_{kind}", lambda s: _valid(kind, s))
    return F.transform(
        valid,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")
        ),
    )


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 2).when(no, 0).otherwise(1)


def _described(s: Column) -> Column:
    """A candidate with its votes (0 no, 1 abstain, 2 yes) and features."""
    match, before = s["match"], F.lower(s["before"])
    digits, size = _digits(match), F.char_length(s["match"])
    only_digits = match.rlike("^[0-9]+$")
    turns = F.size(F.regexp_extract_all(match, F.lit("[0-9]+|[a-z]+|[A-Z]+"), F.lit(0)))
    card = only_digits & F.char_length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    phone = match.contains("(")
    assigned = before.rlike("[=:]\\s*[\"']?$")
    known, unknown = before.rlike(f"(?:{YES_WORDS})[^a-z]*$"), before.rlike(f"(?:{NO_WORDS})[^a-z]*$")
    votes = [
        _vote(match.rlike(SHAPES) | card | phone, match.rlike("^[A-Za-z]+[0-9]{1,4}$")),
        _vote(known, unknown),
        _vote(assigned | before.endswith("+"), before.rlike("[/#.$€-]$") | s["after"].isin("%", "/", "$", "€")),
        _vote((turns >= 4) & (size >= 12), (turns <= 2) & ~card & ~phone),
    ]
    bucket = F.least(F.floor(size / 4), F.lit(12)).cast("string")
    described = F.array(
        F.concat(F.lit("size:"), bucket),
        F.concat(F.lit("turns:"), F.least(turns, F.lit(8)).cast("string")),
        F.concat(
            F.lit("letters:"),
            match.rlike("[A-Z]").cast("int").cast("string"),
            match.rlike("[a-z]").cast("int").cast("string"),
            match.rlike("[g-zG-Z]").cast("int").cast("string"),
        ),
        F.concat(F.lit("before:"), F.when(assigned, "assigned").when(before.rlike("[a-zß-ÿ,.;] $"), "word").otherwise("other")),
        F.concat(F.lit("named:"), known.cast("int").cast("string"), unknown.cast("int").cast("string")),
    )
    # a number that passes a check is judged by that alone
    features = F.when(card, F.array(F.lit("checked:card"))).when(phone, F.array(F.lit("checked:phone"))).otherwise(described)
    kind = F.when(phone | only_digits, "number").otherwise("secret")
    return F.struct(
        s["start"].alias("start"), s["end"].alias("end"), kind.alias("kind"), F.array(*votes).alias("votes"), features.alias("features")
    )


def candidate_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` (with ``base``) plus ``candidates``: those that overlap no base span."""
    found = locate(docs, "_c", CANDIDATE, None, text_col)
    return found.withColumn("candidates", F.transform(_free("_c", "base"), _described)).drop("_c")


def _free(candidates: str, base: str) -> Column:
    """The candidates that overlap no base span.

    Base spans by their start and candidates by their end stand in one sorted
    array, a candidate before the base spans that begin at its end or later. The
    furthest end of a base span so far then tells whether one reaches into it.
    """
    theirs = F.transform(base, lambda b: F.struct((2 * b["start"]).alias("at"), b["end"].alias("to"), F.lit(-1).alias("i")))
    own = F.transform(candidates, lambda c, i: F.struct((2 * c["end"] - 1).alias("at"), F.lit(0).alias("to"), i.alias("i")))

    def free(order: Column) -> Column:
        reach = running(F.transform(order, lambda e: e["to"]), F.greatest, F.lit(0))
        ends = F.zip_with(order, reach, lambda e, r: F.struct(e["i"].alias("i"), r.alias("reach")))
        kept = F.filter(ends, lambda x: (x["i"] >= 0) & (x["reach"] <= F.col(candidates)[x["i"]]["start"]))
        return F.transform(kept, lambda x: F.col(candidates)[x["i"]])

    return F.when(F.size(base) == 0, F.col(candidates)).otherwise(_bind(F.sort_array(F.concat(theirs, own)), free))


def _log_odds(yes: Column, no: Column, all_yes: Column, all_no: Column, ways: int) -> Column:
    """log P(value | yes) / P(value | no), one pseudo-count a value."""
    return F.log((yes + 1.0) / (all_yes + float(ways))) - F.log((no + 1.0) / (all_no + float(ways)))


def _odds(trust: Column, votes: Column) -> Column:
    """Log odds of a vote pattern: an abstention adds nothing."""
    odds = trust[0]
    for k in range(len(LABELERS)):
        odds = odds + trust[k + 1] * (votes[k] - 1)
    return odds


def estimate_reliability(candidates: DataFrame) -> DataFrame:
    """One row, ``trust``: array of log odds, first the prior's, then those of
    each labeler being right when it votes; from a frame with a column ``votes``.

    Expectation-maximisation over the distinct vote patterns, as one
    expression: posteriors from the present trust, then each labeler's share of
    right votes under them, with pseudo-counts for four right votes in five.
    """
    patterns = (
        candidates.groupBy("votes")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
        .agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    )
    start = F.array(F.lit(0.0), *(F.lit(1.0) for _ in LABELERS))

    def total(rows: Column, weight: Callable[[Column], Column]) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda acc, x: acc + weight(x))

    def reliability(rows: Column, k: int) -> Column:
        right = total(rows, lambda x: x["n"] * F.when(x["votes"][k] == 2, x["r"]).when(x["votes"][k] == 0, 1.0 - x["r"]).otherwise(0.0))
        wrong = total(rows, lambda x: x["n"] * F.when(x["votes"][k] == 2, 1.0 - x["r"]).when(x["votes"][k] == 0, x["r"]).otherwise(0.0))
        return F.log((right + 4.0) / (wrong + 1.0))

    def maximise(rows: Column) -> Column:
        prior = F.log((total(rows, lambda x: x["n"] * x["r"]) + 1.0) / (total(rows, lambda x: x["n"] * (1.0 - x["r"])) + 1.0))
        return F.array(prior, *(reliability(rows, k) for k in range(len(LABELERS))))

    def step(trust: Column, _: Column) -> Column:
        rated = F.transform(
            "patterns",
            lambda p: F.struct(
                p["votes"].alias("votes"), p["n"].alias("n"), (1.0 / (1.0 + F.exp(-_odds(trust, p["votes"])))).alias("r")
            ),
        )
        return F.element_at(F.transform(F.array(rated), maximise), 1)  # binds the rated patterns once

    return patterns.select(F.aggregate(F.sequence(F.lit(1), F.lit(EM_ROUNDS)), start, step).alias("trust"))


def train_classifier(candidates: DataFrame) -> DataFrame:
    """One row, ``weights``: map from feature (and ``prior``) to log odds,
    naive Bayes on the soft labels of the labelers' estimated reliabilities.

    ``candidates`` has votes and features. Features are discrete, a few dozen
    values in all, so the sums combine before their shuffle and stay small.
    """
    trust = estimate_reliability(candidates).scalar()
    odds = _odds(F.col("trust"), F.col("votes"))
    counted = candidates.groupBy("votes", "features").agg(F.count(F.lit(1)).alias("n"))
    labelled = counted.withColumn("trust", trust).withColumn("r", 1.0 / (1.0 + F.exp(-odds)))
    sums = (
        labelled.select(F.explode(F.concat("features", F.array(F.lit("prior")))).alias("feature"), "n", "r")
        .groupBy("feature")
        .agg(F.sum(F.col("n") * F.col("r")).alias("yes"), F.sum(F.col("n") * (1 - F.col("r"))).alias("no"))
    )
    grouped = sums.agg(
        F.collect_list(F.struct("feature", "yes", "no")).alias("all"),
        F.coalesce(F.max(F.when(F.col("feature") == "prior", F.col("yes"))), F.lit(0.0)).alias("yes"),
        F.coalesce(F.max(F.when(F.col("feature") == "prior", F.col("no"))), F.lit(0.0)).alias("no"),
    )
    entry = F.transform(
        "all",
        lambda x: F.struct(
            x["feature"].alias("key"),
            F.when(x["feature"] == "prior", F.log((x["yes"] + 1.0) / (x["no"] + 1.0)))
            .otherwise(_log_odds(x["yes"], x["no"], F.col("yes"), F.col("no"), 8))
            .alias("value"),
        ),
    )
    return grouped.select(F.map_from_entries(entry).alias("weights"))


def _text(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``docs``' doc_id with ``base`` and ``spans``: arrays of (start, rank,
    kind, end) sorted by start, then kind; ``spans`` are base and added ones.

    Texts are read once: base spans and candidates are written to the shared
    folder, from which the votes are counted and the spans chosen.
    """
    found = materialize(
        candidate_spans(base_spans(docs.select("doc_id", "text"))).select("doc_id", "base", "candidates"), "pii-candidates"
    )
    seen = found.select(F.explode("candidates").alias("c")).select("c.votes", "c.features")
    weights = materialize(train_classifier(seen), "pii-weights").scalar()

    def accepted(c: Column) -> Column:
        odds = F.aggregate(
            c["features"],
            F.element_at("_weights", F.lit("prior")),
            lambda acc, f: acc + F.coalesce(F.element_at(F.col("_weights"), f), F.lit(0.0)),
        )
        return 1.0 / (1.0 + F.exp(-odds)) >= THRESHOLD

    added = F.transform(
        F.filter("candidates", accepted),
        lambda c: F.struct(
            c["start"].alias("start"),
            F.when(c["kind"] == "secret", len(KINDS)).otherwise(len(KINDS) + 1).alias("rank"),
            c["kind"].alias("kind"),
            c["end"].alias("end"),
        ),
    )
    return found.withColumn("_weights", weights).select(
        "doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans")
    )


def personal_data_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = find_personal_data(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"))

"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Base patterns give spans that always stay. High-recall generators propose further, overlapping
spans. What tells whether a candidate is real is kept apart from what describes it: its check
(Luhn, ranges, digits, a top-level name, letters with digits) and its exact form make the labels,
its normalised format and its context make the features. A candidate that a base span or, for a
secret, an assignment confirms is positive; one that fails its check is negative; one that
passes it in another form is unlabelled and teaches nothing. Trees boosted on these labels give
the share of a candidate's likes that pass. As random strings pass a check at a known rate, that
share tells how likely one that passes is real; a threshold for each kind, set on documents that
the trees have not seen, selects what is redacted besides.

Features are discrete, so all candidates of the corpus fit in one table of feature cells, of a
size fixed by the features, on which the trees are fitted.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import materialise

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans: the base ones, and secrets such as access tokens.
ALL_KINDS = (*KINDS, "secret")

# Each pattern starts where the leftmost match of the plain one would and never backtracks over
# what it has read: `\G` is the end of the match before.
_LOCAL = r"A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap signs without which a base pattern cannot match.
SIGN = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}
#: Generators: wide forms of each kind, also inside or across base matches.
_AT, _DOT = r"(?: ?[\[(]at[\])] ?|@)", r"(?: ?[\[(](?:dot|\.)[\])] ?|\.)"
WIDE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++(?:{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9])[0-9]{1,4}+(?:(?:\.| ?[\[(](?:dot|\.)[\])] ?| \. | dot )[0-9]{1,4}+){3}+(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}(?:[ ./_-][0-9]{4}){3}|[0-9]{4}[ ./_-][0-9]{6}[ ./_-][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+ ?)?+\(?[0-9]++(?:[ ().-]{1,3}+[0-9]++)++",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}+={0,2}+(?![A-Za-z0-9_+/=-])",
}
WIDE_SIGN = {
    "email": r"@|[\[(]at[\])]| at [A-Za-z0-9-]+ dot ",
    "ip": r"[0-9](?:\.| ?[\[(](?:dot|\.)[\])] ?| \. | dot )[0-9]",
    "card": r"[0-9]{13}|[0-9]{4}[ ./_-][0-9]{4}",
    "phone": r"[0-9][ ().-]{1,3}[0-9]",
    "secret": r"[A-Za-z0-9_+/-]{16}",
}
#: Features of a candidate and how many values each may take: their product bounds the table of cells.
FEATURES = {"kind": 5, "groups": 6, "gaps": 3, "paren": 2, "tail": 4, "size": 6, "before": 5, "after": 5, "cue": 2}
#: How often a random string of the generator's form passes the kind's check: Luhn's is one in ten; the others are on the safe side.
CHANCE = {"email": 0.5, "ip": 0.1, "card": 0.1, "phone": 0.5, "secret": 0.3}
CUE = r"(?i)(?:card|visa|iban|phone|tel|call|fax|mobile|mail|contact|addr|host|server|ip)[^A-Za-z]{0,12}$"
ASSIGNED = r"(?i)(?:token|secret|password|passwd|pwd|key|bearer|auth)[^A-Za-z0-9]{1,6}$"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of value pass Luhn's check."""
    digits = F.reverse(_digits(value))
    at = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def weigh(i: Column) -> Column:
        d = F.coalesce(F.substring(digits, i, F.lit(1)).try_cast("int"), F.lit(0))
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)
    return F.aggregate(at, F.lit(0), lambda s, i: s + weigh(i)) % 10 == 0


def octets(value: Column) -> Column:
    """Whether every part of a dotted number is at most 255; leading zeros count for nothing."""
    parts = F.transform(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    return F.forall(parts, lambda x: (F.length(x) <= 3) & (F.substring(x, 1, 3).cast("int") <= 255))


def _valid(kind: str, value: Column) -> Column:
    """Whether a base match passes its kind's check."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return octets(value)
    n = F.length(_digits(value))
    return n.between(13, 19) & luhn(value) if kind == "card" else n.between(9, 15)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once; lambdas would evaluate it for each element."""
    return F.transform(F.array(value), body)[0]


def _normal(kind: str, value: Column) -> Column:
    """A candidate as it would stand in the base form."""
    if kind == "email":
        value = F.regexp_replace(F.regexp_replace(value, r" ?[\[(]at[\])] ?| at ", "@"), r" ?[\[(](?:dot|\.)[\])] ?| dot ", ".")
    if kind == "ip":
        value = F.regexp_replace(value, r" ?[\[(](?:dot|\.)[\])] ?| \. | dot ", ".")
    if kind == "card":
        value = F.translate(value, "./_-", "    ")
    return F.regexp_replace(value, r"^\+ ?", "") if kind == "phone" else value


def _passes(kind: str, normal: Column) -> Column:
    """Whether a candidate passes its kind's check."""
    if kind == "email":
        return normal.rlike(r"\.[A-Za-z]{2,}$")
    if kind == "secret":
        return normal.rlike("[0-9]") & normal.rlike("[A-Za-z]")
    return _valid(kind, normal)


def prefix_sums(values: Column) -> Column:
    """Running sums of an array of numbers. Two levels of about its root keep the copying linear."""
    def running(array: Column) -> Column:
        none = F.expr("cast(array() as array<int>)")
        return F.aggregate(array, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"] + x).alias("out")))["out"]

    def in_parts(v: Column) -> Column:
        wide = F.greatest(F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / wide).cast("int") - 1, F.lit(0))), lambda i: running(F.slice(v, i * wide + 1, wide)))

    def joined(inner: Column) -> Column:
        ends = running(F.transform(inner, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0))))
        return let(F.concat(F.array(F.lit(0)), ends), lambda e: F.flatten(F.transform(inner, lambda p, i: let(F.get(e, i), lambda add: F.transform(p, lambda x: x + add)))))

    return let(values, lambda v: let(in_parts(v), joined))


def matches(text: Column, pattern: str, sign: str) -> Column:
    """Non-overlapping matches as array<struct<start, stop, value, ahead, behind>>: places in code points, up to 24 characters ahead, one behind."""
    kind = "array<struct<start:int,stop:int,value:string,ahead:string,behind:string>>"

    def spans(v: Column) -> Column:
        def span(stop: Column, i: Column) -> Column:
            m = F.get(v["found"], i)
            ahead = F.concat(F.coalesce(F.get(v["found"], i - 1), F.lit("")), F.get(v["pieces"], i))
            behind = F.concat(F.get(v["pieces"], i + 1), F.coalesce(F.get(v["found"], i + 1), F.lit("")))
            return F.struct((stop - F.length(m)).alias("start"), stop.alias("stop"), m.alias("value"), F.right(ahead, F.lit(24)).alias("ahead"), F.left(behind, F.lit(1)).alias("behind"))

        stops = prefix_sums(F.transform(v["found"], lambda m, i: F.length(F.get(v["pieces"], i)) + F.length(m)))
        return F.transform(stops, span)

    cut = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(text.rlike(sign), let(cut, spans)).otherwise(F.expr(f"cast(array() as {kind})"))


def base_spans(text: Column, kind: str) -> Column:
    """The base spans of a kind: the pattern's matches that pass the kind's check."""
    found = F.filter(matches(text, BASE[kind], SIGN[kind]), lambda x: _valid(kind, x["value"]))
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value")))


def _edge(char: Column) -> Column:
    return (
        F.when(char == "", 0).when(char.rlike(r"^\s"), 1).when(char.rlike("^[0-9]"), 2).when(char.rlike(r"^\p{L}"), 3).otherwise(4)
    )


def candidates(text: Column, kind: str) -> Column:
    """The generator's spans of a kind, with features, and whether they pass their check and stand assigned."""
    def features(x: Column, normal: Column, groups: Column) -> Column:
        last, other = F.length(F.try_element_at(groups, F.lit(-1))), F.length(F.try_element_at(groups, F.lit(-2)))
        n = F.length(normal)
        return F.struct(
            x["start"].alias("start"),
            x["stop"].alias("stop"),
            F.lit(ALL_KINDS.index(kind)).alias("kind"),
            F.lit(False).alias("base"),
            _passes(kind, normal).alias("passes"),
            (x["ahead"].rlike(ASSIGNED) if kind == "secret" else F.lit(False)).alias("assigned"),
            F.least(F.size(groups), F.lit(5)).alias("groups"),
            F.least(F.size(F.array_distinct(F.regexp_extract_all(normal, F.lit("[^0-9A-Za-z]"), F.lit(0)))), F.lit(2)).alias("gaps"),
            normal.contains("(").cast("int").alias("paren"),
            F.when(F.size(groups) < 2, 0).when((last == 4) & (other == 3), 1).when((last == 4) & (other == 4), 2).otherwise(3).alias("tail"),
            F.when(n < 8, 0).when(n < 12, 1).when(n < 16, 2).when(n < 20, 3).when(n < 32, 4).otherwise(5).alias("size"),
            _edge(F.right(x["ahead"], F.lit(1))).alias("before"),
            _edge(x["behind"]).alias("after"),
            (F.lit(0) if kind == "secret" else x["ahead"].rlike(CUE).cast("int")).alias("cue"),
        )

    def described(x: Column) -> Column:
        return let(_normal(kind, x["value"]), lambda n: let(F.filter(F.split(n, "[^0-9A-Za-z]+", -1), lambda g: g != ""), lambda g: features(x, n, g)))

    return F.transform(matches(text, WIDE[kind], WIDE_SIGN[kind]), described)


@dataclass
class Boosted:
    """Depth-two regression trees on feature cells, added by gradient boosting of the log loss."""

    bias: float = 0.0
    trees: list[tuple] = field(default_factory=list)  # (feature, value, (feature, value, yes, no), (..., ...))
    thresholds: dict[int, float] = field(default_factory=dict)

    def fit(self, cells: list[tuple[dict[str, int], float, float]], rounds: int, rate: float) -> Boosted:
        """cells: features, labelled candidates in the cell, positive ones among them."""
        total, good = sum(n for _, n, _ in cells) + 2.0, sum(p for _, _, p in cells) + 1.0
        self.bias = math.log(good / (total - good))
        margin = [self.bias] * len(cells)
        tests = sorted({(k, v) for x, _, _ in cells for k, v in x.items()})
        for _ in range(rounds):
            pulls = []
            for (_, n, p), m in zip(cells, margin, strict=True):
                q = 1 / (1 + math.exp(-m))
                pulls.append((p - n * q, n * q * (1 - q)))

            def gain(rows: list[int]) -> float:
                return sum(pulls[i][0] for i in rows) ** 2 / (sum(pulls[i][1] for i in rows) + 1.0) if rows else 0.0

            def best(rows: list[int]) -> tuple[str, int]:
                return max(tests, key=lambda t: gain([i for i in rows if cells[i][0][t[0]] == t[1]]) + gain([i for i in rows if cells[i][0][t[0]] != t[1]]))

            def leaf(rows: list[int]) -> float:
                return rate * sum(pulls[i][0] for i in rows) / (sum(pulls[i][1] for i in rows) + 1.0)

            if not tests:
                break
            everything = list(range(len(cells)))
            k, v = best(everything)
            sides = []
            for rows in ([i for i in everything if cells[i][0][k] == v], [i for i in everything if cells[i][0][k] != v]):
                k2, v2 = best(rows)
                yes, no = [i for i in rows if cells[i][0][k2] == v2], [i for i in rows if cells[i][0][k2] != v2]
                sides.append((k2, v2, leaf(yes), leaf(no)))
            self.trees.append((k, v, *sides))
            margin = [m + self._tree(self.trees[-1], x) for (x, _, _), m in zip(cells, margin, strict=True)]
        return self

    def margin(self, x: dict[str, int]) -> float:
        return self.bias + sum(self._tree(t, x) for t in self.trees)

    @staticmethod
    def _tree(tree: tuple, x: dict[str, int]) -> float:
        k, v, yes, no = tree
        k2, v2, a, b = yes if x[k] == v else no
        return a if x[k2] == v2 else b

    def calibrate(self, cells: list[tuple[dict[str, int], float, float]], precision: float) -> Boosted:
        """A threshold for each kind, from unseen cells, above which candidates that pass their check are real at `precision`.

        Where a share passes and random ones pass at a rate q, (share - q) / (1 - q) are real, and
        of those that pass (share - q) / ((1 - q) * share); so the share must reach
        q / (1 - precision * (1 - q)). The margin is shifted until it foretells the share of all
        unseen candidates of the kind (half of one is taken for a miss); the threshold is where
        it foretells the share that is needed, or higher, where unseen cells above fall short.
        A kind without unseen candidates adds nothing.
        """
        for kind, name in enumerate(ALL_KINDS):
            rows = sorted(((self.margin(x), n, p) for x, n, p in cells if x["kind"] == kind), reverse=True)
            self.thresholds[kind], q = math.inf, CHANCE[name]
            if not rows:
                continue
            need, total = q / (1 - precision * (1 - q)), sum(n for _, n, _ in rows)
            target, lo, hi = (sum(p for *_, p in rows) + 0.5) / (total + 1) * total, -20.0, 20.0
            for _ in range(60):
                shift = (lo + hi) / 2
                lo, hi = (shift, hi) if sum(n / (1 + math.exp(-m - shift)) for m, n, _ in rows) < target else (lo, shift)
            least = math.log(need / (1 - need)) - shift
            above = [r for r in rows if r[0] >= least]
            while above and sum(p for *_, p in above) < need * sum(n for _, n, _ in above):
                least = min((m for m, *_ in above if m > above[-1][0]), default=math.inf)
                above = [r for r in above if r[0] >= least]
            self.thresholds[kind] = least
        return self

    def selects(self, x: Column) -> Column:
        """Whether the trees' margin for a candidate reaches its kind's threshold."""
        margin = F.lit(float(self.bias))
        for k, v, (yk, yv, ya, yb), (nk, nv, na, nb) in self.trees:
            margin = margin + F.when(x[k] == v, F.when(x[yk] == yv, ya).otherwise(yb)).otherwise(F.when(x[nk] == nv, na).otherwise(nb))
        least = F.lit(math.inf)
        for kind, threshold in self.thresholds.items():
            least = F.when(x["kind"] == kind, F.lit(threshold)).otherwise(least)
        return margin >= least - 1e-9


def _touches(x_start: Column, x_stop: Column, among: Column) -> Column:
    """Whether some span of the same text for which `among` holds overlaps the row's own; spans are rows (row, start, stop)."""
    up = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1)
    behind = F.max(F.when(among, F.col("stop"))).over(up) > x_start
    return F.coalesce(behind, F.lit(False)) | F.coalesce(F.min(F.when(among, F.col("start"))).over(down) < x_stop, F.lit(False))


def label(found: DataFrame) -> DataFrame:
    """One row for each candidate of found(row, fold, base, wide): its fields, hit (a base span is the same) and free (touches none)."""
    blank = {k: F.lit(0) for k in FEATURES if k != "kind"}
    given = F.transform(
        "base", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"), F.lit(True).alias("base"), F.lit(True).alias("passes"), F.lit(False).alias("assigned"), *(v.alias(k) for k, v in blank.items()))
    )
    spans = found.filter(F.size("wide") > 0).select("row", "fold", F.explode(F.concat(given, "wide")).alias("x")).select("row", "fold", "x.*")
    same = Window.partitionBy("row", "kind", "start", "stop")
    spans = spans.withColumns({"hit": F.max("base").over(same), "free": ~_touches(F.col("start"), F.col("stop"), F.col("base"))})
    return spans.filter("not base")


def fit_trees(labelled: DataFrame, rounds: int, rate: float, precision: float, folds: int) -> Boosted:
    """Trees on all folds but the first, thresholds on that one; the cells, bounded by the features, reach the driver."""
    positive = F.col("hit") | (F.col("free") & F.col("passes") & F.col("assigned"))
    rows = labelled.withColumn("positive", positive).filter(F.col("positive") | (F.col("free") & ~F.col("passes")))
    counted = rows.groupBy((F.col("fold") == 0).alias("unseen"), *FEATURES).agg(F.count("*").alias("n"), F.sum(F.col("positive").cast("long")).alias("sure"))
    cells = [(r["unseen"], {k: r[k] for k in FEATURES}, float(r["n"]), float(r["sure"])) for r in counted.orderBy("unseen", *FEATURES).collect()]
    model = Boosted().fit([c for unseen, *c in cells if not unseen], rounds, rate)
    return model.calibrate([c for unseen, *c in cells if unseen], precision)


def personal_data(docs: DataFrame, rounds: int = 24, rate: float = 0.4, precision: float = 0.9, folds: int = 4) -> DataFrame:
    """(doc_id, email, ip, card, phone, added) for every row of docs(doc_id, text).

    email to phone hold the base spans of a kind as array<struct<start, stop, value>>, start
    and stop in code points; added holds the spans that the trees select beside them, with
    their kind, in order. Only a candidate that passes its check is added, and never one that
    touches a base span or a selected span of an earlier kind. Null is the empty text; repeated
    rows and ids stand by themselves; other columns are ignored. Copies of a text are in one of
    `folds` folds, as it is the text that deals them out.
    """
    text = F.col("text")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.pmod(F.xxhash64("text"), F.lit(folds)).alias("fold"),
        *(base_spans(text, k).alias(k) for k in KINDS),
        F.concat(*(candidates(text, k) for k in ALL_KINDS)).alias("wide"),
    )
    found = materialise(found, "pii-candidates")
    base = F.concat(*(of_kind(k) for k in KINDS))
    labelled = materialise(label(found.withColumn("base", base)), "pii-labelled")
    model = fit_trees(labelled, rounds, rate, precision, folds)
    x = {k: F.col(k) for k in FEATURES}
    chosen = labelled.filter(F.col("free") & F.col("passes") & model.selects(x)).select("row", "kind", "start", "stop")
    start, stop, kind = F.col("start"), F.col("stop"), F.col("kind")
    taken = F.lit(False)
    for k in range(len(ALL_KINDS) - 1):
        taken = taken | ((kind > k) & _touches(start, stop, kind == k))
    chosen = chosen.withColumn("taken", taken).filter("not taken")
    added = chosen.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "stop"))).alias("added"))
    none = F.expr("cast(array() as array<struct<kind:int,start:int,stop:int>>)")
    return found.select("row", "doc_id", *KINDS).join(added, "row", "left").select("doc_id", *KINDS, F.coalesce("added", none).alias("added"))


def span_list(spans: Column) -> Column:
    """kind:start:end of array<struct<kind, start, stop>>, by kind as listed, then start, comma-joined."""
    names = F.array(*(F.lit(k) for k in ALL_KINDS))
    return F.array_join(
        F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ","
    )


def of_kind(kind: str) -> Column:
    """A kind's base spans as array<struct<kind, start, stop>>."""
    return F.transform(kind, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))


def redact(text: Column, spans: Column) -> Column:
    """text with each span of array<struct<kind, start, stop>> replaced by its kind in brackets; overlapping spans merge."""
    names = F.array(*(F.lit(k.upper()) for k in ALL_KINDS))
    by_start = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
    walked = F.aggregate(
        by_start,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.when(
            x["start"] >= s["at"],
            F.struct(x["stop"].alias("at"), F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit("["), F.element_at(names, x["kind"] + 1), F.lit("]")).alias("out")),
        ).otherwise(F.struct(F.greatest(s["at"], x["stop"]).alias("at"), s["out"].alias("out"))),
    )
    return F.concat(walked["out"], F.substring(text, walked["at"] + 1, F.length(text)))

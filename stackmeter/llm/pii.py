"""Personal-data spans: candidate generators, boosted trees and calibrated thresholds (operator 5).

Base spans are exact patterns.  Beside them, generators of high recall propose spans
that may overlap; gradient-boosted trees score each from its format and context, and a
threshold for each generator, calibrated on held-out examples, selects what is added: half
way between the two kinds where they part, else the least at which precision is kept.
The trees are fitted at the first call on ``SAMPLE`` made-up examples (a fixed number)
and become SQL expressions: on the executors everything is built-in Spark functions,
row by row, without a shuffle.

Offsets are code points, end exclusive.  Patterns use possessive loops, so a text of
any length neither backtracks nor recurses, and every fold over matches is linear in their
number.

Defined results: null and empty texts have no spans; equal rows have equal results; an
added span that overlaps a base span or an earlier added one is dropped.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 4000
TREES, RATE, PRECISION = 24, 0.4, 0.97

#: A run can only start at its beginning or where the last match ended.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: (kind, pattern): proposals beyond the base.
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[({](?:at|AT)[\])}]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[({](?:dot|DOT)[\])}])\x20?[A-Za-z0-9-]{1,63}){1,5}"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){2}[./_][0-9]{2,7}(?![0-9])"),
    ("phone", r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9+])00[1-9][0-9\x20().-]{7,18}[0-9](?![0-9])"),
)
FOR = r"(?i)(?:phone|tel|call|mobile|fax|cell|card|visa|pay|mail|contact|reach|host|server|addr|write)"
AGAINST = r"(?i)(?:order|invoice|version|isbn|serial|ref|part|total|date|page|sum|code|build)"
FEATURES = ("generator", "digits", "length", "marks", "distinct", "luhn", "for", "against", "glued")
_SPAN = "array<struct<s:int,e:int,m:string,b:string,a:string>>"
_PART = "array<struct<m:string,g:string,n:string>>"
#: Items that a fold lists at a time.
BLOCK = 64


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def block_sql(items: str) -> str:
    """The items of block ``j``, one by one: ``slice`` would unpack the whole array each time."""
    return f"transform(sequence(j * {BLOCK}, least((j + 1) * {BLOCK}, size({items})) - 1), i -> {items}[i])"


def fold_sql(items: str, zero: str, kind: str, step: str, emit: str, more: str = "") -> str:
    """A fold over an array column (not empty) that lists what it emits, in time linear in the array.

    ``a.st`` is the state, ``x`` the item; ``emit`` is an array of ``kind``.  Spark copies what a fold carries at every
    step, so one fold carries the state alone and notes it for each block, and then every block lists its own.
    ``more`` adds fields to ``a``; in it ``st`` is the state before the block and ``j`` the block's number.
    """
    names = "".join(f", a.{x.rsplit(' as ', 1)[1]} as {x.rsplit(' as ', 1)[1]}" for x in more.split(";") if x)
    fields = "".join(f", {x}" for x in more.split(";") if x)
    block = block_sql(items)
    states = f"""aggregate(sequence(0, (size({items}) - 1) div {BLOCK}), struct({zero} as st, cast(array() as array<int>) as states),
      (o, j) -> struct(aggregate({block}, struct(o.st as st), (a, x) -> struct({step} as st), a -> a.st) as st, concat(o.states, array(o.st)) as states),
      o -> o.states)"""
    return f"""flatten(transform({states}, (st, j) -> aggregate({block}, struct(st as st, cast(array() as array<{kind}>) as out{fields}),
      (a, x) -> struct({step} as st, concat(a.out, {emit}) as out{names}), a -> a.out)))"""


def parts_sql(matches: str, gaps: str) -> str:
    """Every match with the text before and after it."""
    return f"if(size({matches}) = 0, cast(array() as {_PART}), zip_with({matches}, sequence(0, size({matches}) - 1), (m, i) -> struct(m as m, {gaps}[i] as g, {gaps}[i + 1] as n)))"


def spans_sql(parts: str) -> str:
    """Spans (start, end, match, text before, text after) of all matches of a pattern."""
    span = "array(struct(a.st + length(x.g) as s, a.st + length(x.g) + length(x.m) as e, x.m as m, right(x.g, 24) as b, left(x.n, 4) as a))"
    return f"if(size({parts}) = 0, cast(array() as {_SPAN}), {fold_sql(parts, '0', _SPAN[6:-1], 'a.st + length(x.g) + length(x.m)', span)})"


def digits_sql(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def luhn_sql(digits: str) -> str:
    """Whether a string of digits passes Luhn's test."""
    return f"""(aggregate(sequence(1, greatest(1, length({digits}))), 0L, (acc, i) -> acc + if(i % 2 = 1,
      cast(substr({digits}, length({digits}) - i + 1, 1) as int),
      (cast(substr({digits}, length({digits}) - i + 1, 1) as int) * 2) div 10 + (cast(substr({digits}, length({digits}) - i + 1, 1) as int) * 2) % 10)) % 10 = 0)"""


VALID = {
    "email": "true",
    "ip": r"forall(split(x.m, '\\.'), p -> length(regexp_replace(p, '^0+', '')) <= 3 and coalesce(try_cast(p as int), 0) <= 255)",
    "card": f"length({digits_sql('x.m')}) between 14 and 19 and case when length({digits_sql('x.m')}) between 14 and 19 then {luhn_sql(digits_sql('x.m'))} else false end",
    "phone": f"length({digits_sql('x.m')}) between 10 and 15",
}


def features(generator: int, match: str, before: str, after: str) -> list[float]:
    """The features of a proposal; ``features_sql`` says the same in SQL."""
    digits = re.sub("[^0-9]", "", match)
    total = sum(int(d) if i % 2 == 0 else int(d) * 2 // 10 + int(d) * 2 % 10 for i, d in enumerate(reversed(digits)))
    return [
        generator, len(digits), len(match), len(re.sub("[A-Za-z0-9]", "", match)), len(set(digits)), float(bool(digits) and total % 10 == 0),
        float(bool(re.search(FOR, before))), float(bool(re.search(AGAINST, before))),
        float(bool(re.search(r"[A-Za-z0-9_#=./-]$", before) or re.search(r"^[A-Za-z0-9_/-]", after))),
    ]


def features_sql(generator: int) -> list[str]:
    digits = digits_sql("x.m")
    return [
        str(generator), f"length({digits})", "length(x.m)", "length(regexp_replace(x.m, '[A-Za-z0-9]', ''))",
        f"size(array_distinct(filter(split({digits}, ''), d -> d <> '')))",
        f"if({digits} <> '' and case when {digits} <> '' then {luhn_sql(digits)} else false end, 1, 0)",
        f"if(x.b rlike {_literal(FOR)}, 1, 0)", f"if(x.b rlike {_literal(AGAINST)}, 1, 0)",
        "if(x.b rlike '[A-Za-z0-9_#=./-]$' or x.a rlike '^[A-Za-z0-9_/-]', 1, 0)",
    ]


def examples(n: int = SAMPLE, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Made-up proposals with their features, and whether they are personal data."""
    rng = random.Random(seed)
    pick, num = rng.choice, lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 8)))

    def card() -> str:
        body = num(15)
        return next(body + str(d) for d in range(10) if sum(int(c) if i % 2 == 0 else int(c) * 2 // 10 + int(c) * 2 % 10 for i, c in enumerate(reversed(body + str(d)))) % 10 == 0)

    xs, ys = [], []
    for _ in range(n):
        g, good = rng.randrange(len(GENERATORS)), rng.random() < 0.5
        after = pick([" ", ". ", ", ", ""])
        asked = pick(["phone: ", "call ", "tel ", "contact ", "card ", "mail ", "reach me at ", "server "])
        idle = " ".join(word() for _ in range(3)) + pick([" ", " ", ", "])
        other = pick(["order ", "invoice no ", "ref ", "version ", "serial ", "part ", "code=", "build-"])
        before = (pick([asked, idle]) if rng.random() < 0.8 else asked) if good else (pick([other, other, idle + other]) if rng.random() < 0.75 else word())
        if g == 0:
            left, right = pick(["[]", "()", "{}"])
            match = f"{word()}{pick(['.', '_', ''])}{word()} {left}at{right} {word()} {left}dot{right} {pick(['com', 'org', 'net'])}" if good else f"{pick(['a', 'x', '1'])}{left}at{right}{num(1)}.{num(1)}"
        elif g == 1:
            part = (lambda: f"{rng.randrange(1 << 16):x}") if good else (lambda: num(2))
            match = ":".join(part() for _ in range(8))
        elif g == 2:
            c, mark = card() if good else num(16), pick("./_")
            match = mark.join(c[i : i + 4] for i in range(0, 16, 4))
        elif g == 3:
            match = pick([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)} {num(3)} {num(4)}"]) if good else pick([f"{num(6)}-{num(4)}", f"{num(6)}.{num(4)}", f"{pick('0123') * 3}-{pick('0123') * 3}-{num(4)}"])
        elif good:
            match = pick([f"00{rng.randint(1, 9)}{num(1)} {num(3)} {num(3)} {num(3)}", f"00{rng.randint(1, 9)}{num(1)}-{num(3)}-{num(4)}", f"00{rng.randint(1, 9)}{num(1)} ({num(2)}) {num(4)} {num(3)}"])
        else:
            # Runs of digits as junk prose and part numbers have them, and dotted fillers.
            match = pick([f"00{rng.randint(1, 9)}{num(rng.randint(8, 17))}", f"00{rng.randint(1, 9)}{pick(['...', '---', '. . .'])}{num(4)}{'.' * rng.randint(1, 3)}{num(1)}"])
            before = pick([before, idle, word() + " "])
        xs.append(features(g, match, before[-24:], after))
        ys.append(float(good))
    return np.array(xs), np.array(ys)


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int):
    """A regression tree on gradients: ``(feature, limit, left, right)`` or a leaf's value."""
    best = (1e-6, None, None)
    whole = grad.sum() ** 2 / (hess.sum() + 1)
    for f in range(x.shape[1]) if depth else ():
        for limit in np.unique(x[:, f])[:-1][:64]:
            left = x[:, f] <= limit
            gain = grad[left].sum() ** 2 / (hess[left].sum() + 1) + grad[~left].sum() ** 2 / (hess[~left].sum() + 1) - whole
            if gain > best[0]:
                best = (gain, f, float(limit))
    if best[1] is None:
        return round(float(RATE * grad.sum() / (hess.sum() + 1)), 6)
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], _tree(x[left], grad[left], hess[left], depth - 1), _tree(x[~left], grad[~left], hess[~left], depth - 1)


def _leaf(tree, row: np.ndarray) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@lru_cache(maxsize=1)
def model() -> tuple[list, list[float]]:
    """The trees, and for each generator the score from which a proposal is added."""
    x, y = examples()
    half = len(y) // 2
    score, trees = np.zeros(half), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(_tree(x[:half], y[:half] - p, p * (1 - p), 2))
        score += [_leaf(trees[-1], row) for row in x[:half]]
    held = np.array([sum(_leaf(t, row) for t in trees) for row in x[half:]])
    limits = []
    for g in range(len(GENERATORS)):
        of = x[half:, 0] == g
        s, good = held[of], y[half:][of]
        order = np.argsort(-s, kind="stable")
        right = np.cumsum(good[order]) / np.arange(1, len(order) + 1)
        ends = np.append(s[order][1:] < s[order][:-1], True)  # a threshold takes all of equal scores
        ok = np.flatnonzero((right >= PRECISION) & ends)
        limit = float(s[order][ok[-1]]) if len(ok) else 1e9
        worst, best = s[good > 0].min(initial=np.inf), s[good == 0].max(initial=-np.inf)
        limits.append(round((worst + best) / 2 if -np.inf < best < worst < np.inf else limit, 6))
    return trees, limits


def tree_sql(tree) -> str:
    if not isinstance(tree, tuple):
        return f"{tree}D"
    return f"if(x.f[{tree[0]}] <= {tree[1]}D, {tree_sql(tree[2])}, {tree_sql(tree[3])})"


def _added_sql(generator: int, spans: str) -> str:
    trees, limits = model()
    vector = ", ".join(f"cast({f} as double)" for f in features_sql(generator))
    scored = f"transform({spans}, x -> struct(x.s as s, x.e as e, array({vector}) as f))"
    chosen = f"filter({scored}, x -> {' + '.join(map(tree_sql, trees))} >= {limits[generator]}D - 1e-6D)"
    return f"transform({chosen}, x -> struct(x.s as s, {KINDS.index(GENERATORS[generator][0])} as k, x.e as e))"


def _joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')")


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``__base`` and ``__all``: arrays of (s, k, e), sorted by start, then kind."""
    keep = docs.columns
    out = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    patterns = [BASE[k] for k in KINDS] + [p for _, p in GENERATORS]
    out = out.withColumns({f"__m{i}": F.expr(f"regexp_extract_all(__t, {_literal(p)}, 0)") for i, p in enumerate(patterns)})
    out = out.withColumns({f"__g{i}": F.expr(f"if(size(__m{i}) = 0, cast(array() as array<string>), split(__t, {_literal(p)}, -1))") for i, p in enumerate(patterns)})
    out = out.withColumns({f"__p{i}": F.expr(parts_sql(f"__m{i}", f"__g{i}")) for i in range(len(patterns))})
    out = out.withColumns({f"__s{i}": F.expr(spans_sql(f"__p{i}")) for i in range(len(patterns))})
    base = [f"transform(filter(__s{i}, x -> {VALID[k]}), x -> struct(x.s as s, {i} as k, x.e as e))" for i, k in enumerate(KINDS)]
    out = out.withColumn("__base", F.expr(f"array_sort(concat({', '.join(base)}))"))
    more = [_added_sql(g, f"__s{len(KINDS) + g}") for g in range(len(GENERATORS))]
    out = out.withColumn("__more", F.expr(f"array_sort(concat({', '.join(more)}))"))
    # Added spans among the base spans by start.  Backwards: the next base span's start must not come before an added
    # span's end; forwards: neither may a base span nor an added one that began earlier reach into it.
    found, span = "struct<s:int,t:int,k:int,e:int>", "struct<s:int,k:int,e:int>"
    line = "array_sort(concat(transform(__base, x -> struct(x.s as s, 0 as t, x.k as k, x.e as e)), transform({0}, x -> struct(x.s as s, 1 as t, x.k as k, x.e as e))))"
    none = f"cast(array() as array<{span}>)"
    out = out.withColumn("__back", F.expr(f"if(size(__more) = 0, cast(array() as array<{found}>), reverse({line.format('__more')}))"))
    before = fold_sql("__back", "2147483647", span, "if(x.t = 0, x.s, a.st)", f"if(x.t = 1 and x.e <= a.st, array(struct(x.s as s, x.k as k, x.e as e)), {none})")
    out = out.withColumn("__free", F.expr(f"if(size(__back) = 0, {none}, {before})"))
    out = out.withColumn("__line", F.expr(f"if(size(__free) = 0, cast(array() as array<{found}>), {line.format('__free')})"))
    apart = fold_sql("__line", "-1", span, "if(x.t = 0 or x.s >= a.st, greatest(a.st, x.e), a.st)", f"if(x.t = 1 and x.s >= a.st, array(struct(x.s as s, x.k as k, x.e as e)), {none})")
    out = out.withColumn("__all", F.expr(f"if(size(__line) = 0, __base, array_sort(concat(__base, {apart})))"))
    return out.select(*keep, "__base", "__all")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, their digest, and all spans as text."""
    found = find(docs.select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(__base, x -> x.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined("__base"), 256).alias("base_sha256"), _joined("__all").alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets (overlapping spans as one)."""
    names = "array(" + ", ".join(f"'<{k}>'" for k in KINDS) + ")"
    # A block's part of the text is cut out once, so that positions count within it.
    more = f"st as base;substr({text}, st + 1, greatest(0, array_max(transform({block_sql('__all')}, y -> y.e)) - st)) as part"
    kept = fold_sql("__all", "0", "string", "greatest(a.st, x.e)", f"if(x.s < a.st, cast(array() as array<string>), array(substr(a.part, a.st - a.base + 1, x.s - a.st), {names}[x.k]))", more)
    rest = f"substr({text}, array_max(transform(__all, x -> x.e)) + 1)"
    out = find(docs, text).withColumn(text, F.expr(f"if(size(__all) = 0, {text}, concat(array_join({kept}, ''), {rest}))"))
    return out.select(*docs.columns)

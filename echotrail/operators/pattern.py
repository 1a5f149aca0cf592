"""Exact top-K subgraph matching as a join chain.

A pattern is a small graph of roles. The driver orders its edges (cycles
closed as early as possible), finds its automorphisms, and turns them into
``<`` predicates, so each set of automorphic matches is found once. The
matches are a chain of equi-joins over the symmetric edge table, ending in a
top-K that never sorts all of them.

With bounds (``top_matches_bounded``) a partial match carries its score and
what its missing edges weigh at most, from the heaviest edges of its nodes, and
is dropped once it can't reach a score that k matches are known to have. A role
that closes a cycle is taken from the shorter of the two neighbour lists and
looked up in the other, so that a hub's list is never gone through.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import save


@dataclass(frozen=True)
class Pattern:
    """Edges between roles 0..n-1, and a type for each role or none at all."""

    edges: tuple[tuple[int, int], ...]
    types: tuple[int, ...] | None = None

    @property
    def roles(self) -> int:
        return 1 + max(max(e) for e in self.edges)

    def automorphisms(self) -> list[tuple[int, ...]]:
        own = {frozenset(e) for e in self.edges}
        return [
            p
            for p in permutations(range(self.roles))
            if {frozenset((p[i], p[j])) for i, j in self.edges} == own and (self.types is None or all(self.types[p[i]] == self.types[i] for i in range(self.roles)))
        ]

    def order_constraints(self) -> list[tuple[int, int]]:
        """Pairs (i, j), node of i < node of j, that leave one of each set of automorphic matches."""
        group, out = self.automorphisms(), []
        for v in range(self.roles):
            orbit = {p[v] for p in group}
            out += [(v, u) for u in sorted(orbit) if u != v]
            group = [p for p in group if p[v] == v]
        return out

    def plan(self) -> list[tuple[int, int]]:
        """The edges, each with its first role bound by an earlier one; closing edges come first."""
        left = [tuple(e) for e in self.edges]
        out = [left.pop(0)]
        bound = set(out[0])
        while left:
            e = next((e for e in left if set(e) <= bound), None) or next(e for e in left if set(e) & bound)
            left.remove(e)
            out.append(e if e[0] in bound else (e[1], e[0]))
            bound |= set(e)
        return out


EDGE = Pattern(((0, 1),))
PATH3 = Pattern(((0, 1), (1, 2)))
PATH4 = Pattern(((0, 1), (1, 2), (2, 3)))
STAR = Pattern(((0, 1), (0, 2), (0, 3)))
TRIANGLE = Pattern(((0, 1), (0, 2), (1, 2)))
SQUARE = Pattern(((0, 1), (1, 2), (2, 3), (0, 3)))


def matches(
    edges: DataFrame, pattern: Pattern, types: DataFrame | None = None, injective: bool = True, all_images: bool = False,
    plan: list[tuple[int, int]] | None = None, first: DataFrame | None = None,
) -> DataFrame:
    """All matches as columns n_0, n_1, ... and score (the sum of weights).

    ``edges(src, dst, w)`` holds both directions. Injective: different roles
    are different nodes. Otherwise only data edges must differ: an edge serves
    one pattern edge. all_images keeps every automorphic image.
    """
    constraints = [] if all_images else pattern.order_constraints()
    out: DataFrame | None = None
    seen: list[tuple[int, int]] = []
    for i, j in plan or pattern.plan():
        own_edges = edges if first is None or out is not None else first
        step = own_edges.select(F.col("src").alias(f"n_{i}"), F.col("dst").alias(f"n_{j}"), F.col("w").alias(f"w_{len(seen)}"))
        bound = set() if out is None else {r for e in seen for r in e}
        if out is None:
            out = step
        else:
            out = out.join(step, [f"n_{r}" for r in (i, j) if r in bound])
        new = [r for r in (i, j) if r not in bound]
        where: list[Column] = []
        if pattern.types is not None and types is not None:
            for r in new:
                own = types.filter(F.col("type") == pattern.types[r]).select(F.col("node").alias(f"n_{r}"))
                out = out.join(own, f"n_{r}", "left_semi")
        if injective:
            where += [F.col(f"n_{r}") != F.col(f"n_{s}") for r in new for s in bound]
        else:
            for p, q in seen:
                same = (F.col(f"n_{i}") == F.col(f"n_{p}")) & (F.col(f"n_{j}") == F.col(f"n_{q}"))
                turned = (F.col(f"n_{i}") == F.col(f"n_{q}")) & (F.col(f"n_{j}") == F.col(f"n_{p}"))
                where.append(~(same | turned))
        where += [F.col(f"n_{p}") < F.col(f"n_{q}") for p, q in constraints if {p, q} <= bound | {i, j} and {p, q} & set(new)]
        if where:
            out = out.filter(reduce(lambda x, y: x & y, where))
        seen.append((i, j))
    score = reduce(lambda x, y: x + y, [F.col(f"w_{k}") for k in range(len(seen))])
    return out.select(*[F.col(f"n_{r}") for r in range(pattern.roles)], score.alias("score"))


def top_matches(edges: DataFrame, pattern: Pattern, k: int, types: DataFrame | None = None, injective: bool = True, all_images: bool = False) -> DataFrame:
    """The k best matches; ties go by the node tuple."""
    if injective and all_images:
        return _best_images(top_matches(edges, pattern, k, types), pattern, k)
    found = matches(edges, pattern, types, injective, all_images)
    return found.orderBy(F.desc("score"), *[f"n_{r}" for r in range(pattern.roles)]).limit(k)


def _best_images(found: DataFrame, pattern: Pattern, k: int) -> DataFrame:
    """The k best of all images of the k best matches: an image scores as its match does, and no image's tuple is less."""
    order = [F.desc("score"), *[f"n_{r}" for r in range(pattern.roles)]]
    images = F.array(*[F.struct(*[F.col(f"n_{p[r]}").alias(f"n_{r}") for r in range(pattern.roles)]) for p in pattern.automorphisms()])
    return found.select(F.explode(images).alias("m"), "score").select("m.*", "score").orderBy(*order).limit(k)


def top_matches_in_batches(edges: DataFrame, pattern: Pattern, k: int, injective: bool = True, all_images: bool = False) -> DataFrame:
    """The same rows, looking only at matches with a heavy edge: first the best few, then all that may score as much."""
    return top_matches_bounded(edges, pattern, k, None, injective, all_images)


def bounded_edges(edges: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Edges with both nodes' types (0 without), degrees and heaviest edge to each type (a map of at most as many entries as types)."""
    if types is None:
        typed = edges.select("src", "dst", "w", F.lit(0).alias("t"))
    else:
        typed = edges.select("src", "dst", "w").join(types.select(F.col("node").alias("dst"), F.col("type").cast("int").alias("t")), "dst")
    by_type = typed.groupBy("src", "t").agg(F.max("w").alias("h"), F.count("*").alias("n"))
    ends = by_type.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("t", "h"))).alias("h"), F.sum("n").alias("d"))
    if types is not None:
        ends = ends.join(types.select(F.col("node").alias("src"), F.col("type").cast("int").alias("t")), "src")
    else:
        ends = ends.withColumn("t", F.lit(0))
    ends = save(ends, "ends")
    sides = [ends.select(F.col("src").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("h", "d", "t")]) for c in ("src", "dst")]
    return edges.select("src", "dst", "w").join(sides[0], "src").join(sides[1], "dst")


def both_directions(one: DataFrame) -> DataFrame:
    """Bounded edges with src <= dst, and turned; a loop isn't turned."""
    turn = lambda c: c.replace("src", "dst") if "src" in c else c.replace("dst", "src")
    return one.unionByName(one.filter("src < dst").select(*[F.col(c).alias(turn(c)) for c in one.columns]))


def bounded_matches(
    edges: DataFrame, pattern: Pattern, floor: float | None = None, injective: bool = True, all_images: bool = False, trace: list[DataFrame] | None = None
) -> DataFrame:
    """The matches of ``matches`` that score ``floor`` or more, from ``bounded_edges``; ``trace`` gets the partial matches after each step.

    A missing edge weighs at most the heaviest edge that each of its bound
    nodes has to the other role's type, or, with neither bound, the heaviest
    of all; the rest is a sum of these, so no match that reaches the floor is
    lost, whatever else its nodes are joined by.
    """
    kind = lambda r: pattern.types[r] if pattern.types is not None else 0
    constraints = [] if all_images else pattern.order_constraints()
    heaviest = None if floor is None else edges.agg(F.max("w")).first()[0]
    plan, out, seen, bound = pattern.plan(), None, [], set()

    def side(step: DataFrame, role: int, c: str) -> list[Column]:
        return [F.col(c).alias(f"n_{role}"), F.col(f"h_{c}").alias(f"h_{role}"), F.col(f"d_{c}").alias(f"d_{role}")]

    def of_types(step: DataFrame, roles: dict[str, int]) -> DataFrame:
        return step.filter(reduce(lambda x, y: x & y, [F.col(f"t_{c}") == kind(r) for c, r in roles.items()])) if pattern.types is not None else step

    def most(i: int, j: int) -> Column:
        ends = [F.col(f"h_{p}")[F.lit(kind(q))] for p, q in ((i, j), (j, i)) if p in bound]
        return F.least(*ends) if len(ends) == 2 else ends[0] if ends else F.lit(heaviest)

    while plan:
        (i, j), new = plan.pop(0), set()
        if out is None:
            step = of_types(edges, {"src": i, "dst": j})
            out, edges_now, new = step.select(*side(step, i, "src"), *side(step, j, "dst"), F.col("w").alias("w_0")), [(i, j)], {i, j}
        elif {i, j} <= bound:
            step = edges.select(F.col("src").alias(f"n_{i}"), F.col("dst").alias(f"n_{j}"), F.col("w").alias(f"w_{len(seen)}"))
            out, edges_now = out.join(step, [f"n_{i}", f"n_{j}"]), [(i, j)]
        else:
            step, w, new = of_types(edges, {"dst": j}), f"w_{len(seen)}", {j}
            other = next((p if q == j else q for p, q in plan[:1] if j in (p, q) and {p, q} - {j} <= bound), None)
            if other is None:
                out, edges_now = out.join(step.select(F.col("src").alias(f"n_{i}"), *side(step, j, "dst"), F.col("w").alias(w)), f"n_{i}"), [(i, j)]
            else:
                plan.pop(0)
                turned = F.col(f"d_{i}") > F.col(f"d_{other}")  # the shorter list is gone through, the other one asked
                out = out.withColumns({"_near": F.when(turned, F.col(f"n_{other}")).otherwise(F.col(f"n_{i}")), "_far": F.when(turned, F.col(f"n_{i}")).otherwise(F.col(f"n_{other}"))})
                out = out.join(step.select(F.col("src").alias("_near"), *side(step, j, "dst"), F.col("w").alias("_w")), "_near")
                if trace is not None:
                    trace.append(out)
                out = out.join(edges.select(F.col("src").alias("_far"), F.col("dst").alias(f"n_{j}"), F.col("w").alias("_x")), ["_far", f"n_{j}"])
                pair = {w: F.when(turned, F.col("_x")).otherwise(F.col("_w")), f"w_{len(seen) + 1}": F.when(turned, F.col("_w")).otherwise(F.col("_x"))}
                out, edges_now = out.withColumns(pair).drop("_near", "_far", "_w", "_x"), [(i, j), (other, j)]
        where: list[Column] = []
        if injective:
            where += [F.col(f"n_{r}") != F.col(f"n_{s}") for r in new for s in bound | new if s < r or s in bound]
        for i, j in edges_now:
            if not injective:
                for p, q in seen:
                    same = (F.col(f"n_{i}") == F.col(f"n_{p}")) & (F.col(f"n_{j}") == F.col(f"n_{q}"))
                    turned = (F.col(f"n_{i}") == F.col(f"n_{q}")) & (F.col(f"n_{j}") == F.col(f"n_{p}"))
                    where.append(~(same | turned))
            seen.append((i, j))
        bound |= new
        where += [F.col(f"n_{p}") < F.col(f"n_{q}") for p, q in constraints if {p, q} <= bound and {p, q} & new]
        if floor is not None:
            scores = [F.col(f"w_{k}") for k in range(len(seen))] + [most(p, q) for p, q in plan]
            where.append(reduce(lambda x, y: x + y, scores) >= floor)
        out = out.filter(reduce(lambda x, y: x & y, where)) if where else out
        if trace is not None:
            trace.append(out)
    score = reduce(lambda x, y: x + y, [F.col(f"w_{k}") for k in range(len(seen))])
    return out.select(*[F.col(f"n_{r}") for r in range(pattern.roles)], score.alias("score"))


def anchors(pattern: Pattern) -> list[tuple[int, int]]:
    """One edge of each set of edges that automorphisms turn into each other."""
    out, seen = [], set()
    for i, j in pattern.edges:
        if frozenset((i, j)) not in seen:
            out.append((i, j))
            seen |= {frozenset((p[i], p[j])) for p in pattern.automorphisms()}
    return out


def heavy_matches(
    edges: DataFrame, pattern: Pattern, anchor: tuple[int, int], first: DataFrame, floor: float | None = None, injective: bool = True, beam: int | None = None,
    trace: list[DataFrame] | None = None,
) -> DataFrame:
    """All images of the matches whose heaviest edge is ``anchor``, one of ``first``, and that score ``floor`` or more; from ``bounded_edges``.

    A missing edge weighs at most what its bound nodes' heaviest edges and the
    anchor do. With ``beam`` only so many of the heaviest partial matches are
    kept at every step: some matches, not all.

    The first edges, and partial matches that an edge is to close, are written:
    few of them are sent to the edges by the planner, which knows their size,
    so that the table of all edges is not shuffled for them.
    """
    kind = lambda r: pattern.types[r] if pattern.types is not None else 0
    plan, bound, seen = Pattern((anchor, *[e for e in pattern.edges if e != anchor]), pattern.types).plan(), set(), []

    def side(role: int, c: str, known: set[int]) -> list[Column]:
        """A node, its degree and the most that its edges to roles not bound with it weigh."""
        open_to = [q if p == role else p for p, q in pattern.edges if role in (p, q) and not {p, q} <= known]
        return [F.col(c).alias(f"n_{role}"), *([F.col(f"d_{c}").alias(f"d_{role}")] if open_to else []), *[F.col(f"h_{c}")[F.lit(kind(q))].alias(f"h_{role}_{q}") for q in open_to]]

    def of_types(step: DataFrame, roles: dict[str, int]) -> DataFrame:
        return step.filter(reduce(lambda x, y: x & y, [F.col(f"t_{c}") == kind(r) for c, r in roles.items()])) if pattern.types is not None else step

    def most(rows: DataFrame, i: int, j: int) -> Column:
        known = [F.col(c) for c in ("w_0", f"h_{i}_{j}", f"h_{j}_{i}") if c in rows.columns]
        return F.least(*known) if len(known) > 1 else known[0]

    def reaching(rows: DataFrame, weights: list[str], missing: list[tuple[int, int]]) -> DataFrame:
        if floor is None:
            return rows
        return rows.filter(reduce(lambda x, y: x + y, [F.col(w) for w in weights] + [most(rows, p, q) for p, q in missing]) >= floor)

    def best(rows: DataFrame) -> DataFrame:
        if beam is None:
            return rows
        score = reduce(lambda x, y: x + y, [F.col(f"w_{k}") for k in range(len(seen))])
        return F.broadcast(save(rows.orderBy(F.desc(score), *[f"n_{r}" for r in sorted(bound)]).limit(beam), "partial"))

    def apart(rows: DataFrame, j: int) -> DataFrame:
        return rows.filter(reduce(lambda x, y: x & y, [F.col(f"n_{j}") != F.col(f"n_{r}") for r in sorted(bound - {j})])) if injective else rows

    def fresh(rows: DataFrame, i: int, j: int) -> DataFrame:
        """Without rows in which the edge serves an earlier one too."""
        if injective:
            return rows
        for p, q in seen:
            same = (F.col(f"n_{i}") == F.col(f"n_{p}")) & (F.col(f"n_{j}") == F.col(f"n_{q}"))
            turned = (F.col(f"n_{i}") == F.col(f"n_{q}")) & (F.col(f"n_{j}") == F.col(f"n_{p}"))
            rows = rows.filter(~(same | turned))
        return rows

    i, j = plan.pop(0)
    out = of_types(first, {"src": i, "dst": j}).select(*side(i, "src", {i, j}), *side(j, "dst", {i, j}), F.col("w").alias("w_0"))
    bound, seen = {i, j}, [(i, j)]
    out = best(reaching(out, ["w_0"], plan)) if beam is not None else save(reaching(out, ["w_0"], plan), "partial")
    while plan:
        (i, j), w = plan.pop(0), f"w_{len(seen)}"
        weights = [f"w_{k}" for k in range(len(seen) + 1)]
        if {i, j} <= bound:
            out = out.join(edges.select(F.col("src").alias(f"n_{i}"), F.col("dst").alias(f"n_{j}"), F.col("w").alias(w)), [f"n_{i}", f"n_{j}"])
            out = fresh(out, i, j)
            seen.append((i, j))
        else:
            step = of_types(edges, {"dst": j})
            other = next((p if q == j else q for p, q in plan[:1] if j in (p, q) and {p, q} - {j} <= bound), None)
            if other is None:
                out = out.join(step.select(F.col("src").alias(f"n_{i}"), *side(j, "dst", bound | {j}), F.col("w").alias(w)), f"n_{i}")
                out = fresh(apart(out, j), i, j)
                seen.append((i, j))
            else:
                closing = plan.pop(0)
                ends = out.select(F.explode(F.array(f"n_{i}", f"n_{other}")).alias("src")).distinct()
                turned = F.col(f"d_{i}") > F.col(f"d_{other}")  # the shorter list is gone through, the other one asked
                out = out.withColumns({"_near": F.when(turned, F.col(f"n_{other}")).otherwise(F.col(f"n_{i}")), "_far": F.when(turned, F.col(f"n_{i}")).otherwise(F.col(f"n_{other}"))})
                out = out.join(step.select(F.col("src").alias("_near"), *side(j, "dst", {j}), F.col("w").alias("_w")), "_near").filter(F.col("_w") <= F.col("w_0"))
                # either list's other edge weighs what the asked node's heaviest does at most
                asked = F.when(turned, F.col(f"h_{i}_{j}")).otherwise(F.col(f"h_{other}_{j}"))
                if floor is not None:
                    still = [F.col(x) for x in [*weights[:-1], "_w"]] + [F.least(asked, F.col("w_0"), F.col(f"h_{j}_{i}"))] + [most(out, p, q) for p, q in plan]
                    out = out.filter(reduce(lambda x, y: x + y, still) >= floor)
                out = apart(out, j)
                out = out if beam is not None else save(out, "partial")
                if trace is not None:
                    trace.append(out)
                # a beam's nodes are few, and their edges are all that close its matches
                closers = edges if beam is None else edges.join(F.broadcast(ends), "src", "left_semi")
                out = out.join(closers.select(F.col("src").alias("_far"), F.col("dst").alias(f"n_{j}"), F.col("w").alias("_x")), ["_far", f"n_{j}"])
                pair = {w: F.when(turned, F.col("_x")).otherwise(F.col("_w")), f"w_{len(seen) + 1}": F.when(turned, F.col("_w")).otherwise(F.col("_x"))}
                out = out.withColumns(pair).drop("_near", "_far", "_w", "_x")
                out = fresh(out, i, j)
                seen.append((i, j))
                out = fresh(out, *closing)
                seen.append(closing)
                weights.append(f"w_{len(seen) - 1}")
                out = out.filter(F.col(weights[-1]) <= F.col("w_0"))
        bound |= {i, j}
        out = out.filter(F.col(w) <= F.col("w_0"))
        out = reaching(out, weights, plan)
        needed = {f"{x}_{p}_{q}" for x in "h" for a, b in plan for p, q in ((a, b), (b, a))} | {f"d_{r}" for e in plan for r in e}
        out = out.select(*[c for c in out.columns if c in needed or c.startswith(("n_", "w_"))])
        out = best(out) if plan else out
        if trace is not None:
            trace.append(out)
    score = reduce(lambda x, y: x + y, [F.col(f"w_{k}") for k in range(len(seen))])
    return out.select(*[F.col(f"n_{r}") for r in range(pattern.roles)], score.alias("score"))


def _images(found: DataFrame, pattern: Pattern, all_images: bool) -> DataFrame:
    """Each match once, or every image of each, from some of its images."""
    roles = [f"n_{r}" for r in range(pattern.roles)]
    every = F.array(*[F.struct(*[F.col(f"n_{p[r]}").alias(f"n_{r}") for r in range(pattern.roles)]) for p in pattern.automorphisms()])
    out = found.select(F.explode(every).alias("m"), "score").select("m.*", "score")
    constraints = [] if all_images else pattern.order_constraints()
    if constraints:
        out = out.filter(reduce(lambda x, y: x & y, [F.col(f"n_{p}") < F.col(f"n_{q}") for p, q in constraints]))
    return out.groupBy(*roles).agg(F.max("score").alias("score"))


#: Partial matches that the search for a first floor keeps at every step, what they are multiplied by while too few matches are found, and how often.
BEAM, GROWTH, WIDER = 4096, 10, 3


def known_score(whole: DataFrame, pattern: Pattern, k: int, injective: bool = True, all_images: bool = False) -> float | None:
    """A score that k matches reach, from matches grown along the heaviest edges; None if too few were found.

    Any k matches give a sound floor, so it doesn't matter that others are passed over.
    """
    beam = max(BEAM, 16 * k)
    for _ in range(WIDER):
        first = whole.orderBy(F.desc("w"), "src", "dst").limit(beam)
        found = reduce(lambda x, y: x.union(y), [heavy_matches(whole, pattern, e, first, None, injective, beam) for e in anchors(pattern)])
        best = _images(found, pattern, all_images).orderBy(F.desc("score")).limit(k)
        last = best.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        if last.n == k:
            return last.least
        beam *= GROWTH
    return None


def top_matches_bounded(
    edges: DataFrame, pattern: Pattern, k: int, types: DataFrame | None = None, injective: bool = True, all_images: bool = False, trace: list[DataFrame] | None = None
) -> DataFrame:
    """The rows of ``top_matches``: with a score that k matches are known to reach, only matches with an edge of at least its mean are looked for.

    A match that scores s has an edge of s / edges or more. So matches are grown
    from the heavy edges as their heaviest, and partial ones that stay below
    the floor are dropped. Where no edge is too light for that, all edges are
    joined in the pattern's order. ``edges`` are alike in both directions; with
    their bounds they are written in one.
    """
    order = [F.desc("score"), *[f"n_{r}" for r in range(pattern.roles)]]
    whole = both_directions(save(bounded_edges(edges, types).filter("src <= dst"), "bounded"))
    floor, lightest = known_score(whole, pattern, k, injective, all_images), whole.agg(F.min("w")).first()[0]
    if floor is None or len(pattern.edges) * lightest >= floor:
        if injective and all_images:
            return _best_images(bounded_matches(whole, pattern, floor, trace=trace).orderBy(*order).limit(k), pattern, k)
        return bounded_matches(whole, pattern, floor, injective, all_images, trace).orderBy(*order).limit(k)
    first = whole.filter(F.col("w") * len(pattern.edges) >= floor)
    found = reduce(lambda x, y: x.union(y), [heavy_matches(whole, pattern, e, first, floor, injective, None, trace) for e in anchors(pattern)])
    return _images(found, pattern, all_images).orderBy(*order).limit(k)


def one_per_node_set(found: DataFrame, keep: str = "min") -> DataFrame:
    """Of matches on the same nodes the one with the lowest (or highest) score; ties by the node tuple."""
    roles = [c for c in found.columns if c.startswith("n_")]
    nodes = F.array_join(F.array_sort(F.array(*[F.col(c) for c in roles])), "#")
    order = F.struct((F.col("score") if keep == "min" else -F.col("score")).alias("o"), *roles)
    best = found.withColumn("node_set", nodes).groupBy("node_set").agg(F.min_by(F.struct(*roles, "score"), order).alias("m"))
    return best.select("node_set", "m.*")


def pattern_of(spark: SparkSession, graph: DataFrame, exemplars: list[int]) -> tuple[Pattern, list[int]] | None:
    """The pattern that some exemplar nodes form in the graph, and the node of each role.

    Isolated exemplars drop out; without any edge there is no pattern.
    """
    pairs = [(min(p), max(p)) for p in combinations(sorted(set(exemplars)), 2)]
    if not pairs:
        return None
    wanted = spark.createDataFrame(pairs, "a long, b long")
    linked = sorted((r.a, r.b) for r in graph.select("a", "b").join(F.broadcast(wanted), ["a", "b"], "left_semi").collect())
    nodes = sorted({x for p in linked for x in p})
    if not linked:
        return None
    at = {x: i for i, x in enumerate(nodes)}
    return Pattern(tuple((at[a], at[b]) for a, b in linked)), nodes


def top_matches_with_free(edges: DataFrame, links: list[tuple[int, int]], roles: int, k: int, at_first: int = 8) -> DataFrame:
    """The k best matches of ``links`` between some of the roles; a role without any takes every other node of the graph.

    Of two roles that no link joins the first such pair is in the order of its
    nodes. Tuples go by score and nodes, so those of the first few scores (and
    first nodes, if role 0 is linked) are made, and of more until k are found.
    All matches of the links are looked at.
    """
    own = sorted({r for e in links for r in e})
    linked = Pattern(tuple((own.index(i), own.index(j)) for i, j in links))
    found = matches(edges, linked, all_images=True)
    found = save(found.select(*[F.col(f"n_{i}").alias(f"n_{r}") for i, r in enumerate(own)], "score"), "linked")
    nodes = save(edges.select(F.col("src").alias("node")).distinct(), "nodes")
    names, joined = [f"n_{r}" for r in range(roles)], {frozenset(e) for e in links}
    i, j = next(p for p in combinations(range(roles), 2) if frozenset(p) not in joined)
    keys, upto = ["score", *(["n_0"] if 0 in own else [])], at_first
    while True:
        heads = save(found.select(*keys).distinct().orderBy(F.desc("score"), *keys[1:]).limit(upto), "heads")
        out = found.join(F.broadcast(heads), keys)
        for r in sorted(set(range(roles)) - set(own)):
            bound = [c for c in out.columns if c.startswith("n_")]
            out = out.crossJoin(nodes.select(F.col("node").alias(f"n_{r}"))).filter(reduce(lambda x, y: x & y, [F.col(c) != F.col(f"n_{r}") for c in bound]))
        out = save(out.filter(F.col(f"n_{i}") < F.col(f"n_{j}")).orderBy(F.desc("score"), *names).limit(k).select(*names, "score"), "with-free")
        if out.count() == k or heads.count() < upto:
            return out
        upto *= 8


def first_tuples(edges: DataFrame, roles: int, k: int) -> DataFrame:
    """The first ``k`` tuples of ``roles`` (two at least) different nodes of ``edges``, at a score of 0; the first two are in the order of their nodes.

    None of them has a node past the first ``k + roles``, whichever of these
    stands for such a node gives an earlier tuple; and as every pair is
    completed by the other nodes, only the first ``k`` tuples of some roles go on.
    """
    nodes = save(edges.select(F.col("src").alias("node")).distinct().orderBy("node").limit(k + roles), "nodes")
    out = nodes.select(F.col("node").alias("n_0"))
    for r in range(1, roles):
        bound = [F.col(c) < F.col("n_1") if r == 1 else F.col(c) != F.col(f"n_{r}") for c in out.columns]
        out = out.crossJoin(nodes.select(F.col("node").alias(f"n_{r}"))).filter(reduce(lambda x, y: x & y, bound))
        out = save(out.orderBy(*out.columns).limit(k), "tuples")
    return out.withColumn("score", F.lit(0).cast("long"))


def with_query_first(found: DataFrame, nodes: list[int]) -> DataFrame:
    """Search results with the query itself in front, at an infinite score."""
    spark = found.sparkSession
    roles = [c for c in found.columns if c.startswith("n_")]
    own = spark.createDataFrame([(*nodes, float("inf"))], ", ".join(f"{c} long" for c in roles) + ", score double")
    return own.unionByName(found.select(*roles, F.col("score").cast("double")))

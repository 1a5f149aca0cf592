"""DuckDB SQL for pattern queries, written from the match definition."""

from __future__ import annotations

from ..operators.pattern import Pattern


def match_sql(pattern: Pattern, injective: bool = True, all_images: bool = False) -> str:
    """A select over ``sym(src, dst, w)`` (and ``types``) that lists all matches."""
    alias = [f"e{k}" for k in range(len(pattern.edges))]
    node: dict[int, str] = {}
    where = []
    for e, (i, j) in zip(alias, pattern.edges, strict=True):
        for role, column in ((i, f"{e}.src"), (j, f"{e}.dst")):
            if role in node:
                where.append(f"{column} = {node[role]}")
            else:
                node[role] = column
    roles = range(pattern.roles)
    tables = [f"sym {e}" for e in alias]
    if injective:
        where += [f"{node[i]} <> {node[j]}" for i in roles for j in roles if i < j]
    else:
        where += [
            f"(least({a}.src, {a}.dst) <> least({b}.src, {b}.dst) or greatest({a}.src, {a}.dst) <> greatest({b}.src, {b}.dst))"
            for x, a in enumerate(alias) for b in alias[x + 1 :]
        ]
    if pattern.types is not None:
        tables += [f"types t{r}" for r in roles]
        where += [f"t{r}.node = {node[r]} and t{r}.type = {pattern.types[r]}" for r in roles]
    if not all_images:
        where += [f"{node[i]} < {node[j]}" for i, j in pattern.order_constraints()]
    columns = ", ".join(f"{node[r]} as n_{r}" for r in roles)
    score = " + ".join(f"{e}.w" for e in alias)
    return f"select {columns}, {score} as score from {', '.join(tables)}" + (f" where {' and '.join(where)}" if where else "")


def top_sql(pattern: Pattern, k: int, injective: bool = True, all_images: bool = False) -> str:
    order = ", ".join(f"n_{r}" for r in range(pattern.roles))
    return f"select * from ({match_sql(pattern, injective, all_images)}) order by score desc, {order} limit {k}"

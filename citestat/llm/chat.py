"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in alternation, the
assistant last. Turns that break this are repaired at the least cost: a turn may be merged into
the one before, given another role, or preceded by an empty turn. The cheapest repair is a
shortest path over the automaton's states (what the last turn was), found by dynamic programming.

A turn maps costs per state to costs per state, a (min, +) matrix, and matrices of turns in a row
multiply. So turns are numbered in order over the whole table and cut into chunks of `CHUNK`
rows, whatever the conversations' lengths. Only a chunk's first and last conversation can reach
beyond it; their matrices are steps of the same kind and are cut into blocks of `FAN` chunks, and
so on until one block is left. Downwards again, each block tells the states at the borders of its
parts, and each chunk repairs its turns by itself. No task holds a conversation as a whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData, functions as F

from citestat.llm.common import col
from citestat.operators.tables import number_rows
from citestat.session import save_and_reload

CHUNK = FAN = 4096
MERGE, RELABEL, INSERT = 1.0, 1.5, 2.0

ROLES = ("system", "user", "assistant")
#: State 0 is the start; state k is "the last turn was ROLES[k - 1]".
LEGAL = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}


class Costs:
    """Cheapest way from state to state over one turn, by the turn's role."""

    def __init__(self, merge: float = MERGE, relabel: float = RELABEL, insert: float = INSERT):
        self.step = np.full((4, 4, 4), np.inf)
        #: (action, inserted role or 0)
        self.how: dict[tuple[int, int, int], tuple[str, int]] = {}
        #: To end in each state, the assistant being last.
        self.end = np.array([0.0, 2 * insert, insert, 0.0])
        for role in range(4):
            for q in range(4):
                for x in range(1, 4):
                    named = 0.0 if x == role else relabel
                    ways = [(named, "start", 0)] if (q, x) in LEGAL else []
                    ways += [(named + insert, "start", y) for y in (1, 2, 3) if (q, y) in LEGAL and (y, x) in LEGAL]
                    ways += [(named + merge, "merge", 0)] if q == x else []
                    if ways:
                        cost, action, inserted = min(ways, key=lambda w: w[0])
                        self.step[role, q, x] = cost
                        self.how[role, q, x] = (action, inserted)

    def over(self, steps: np.ndarray) -> np.ndarray:
        """Matrix of several steps in a row."""
        total = steps[0]
        for step in steps[1:]:
            total = (total[:, :, None] + step[None, :, :]).min(axis=1)
        return total

    def path(self, steps: np.ndarray, first: int, last: int | None = None) -> list[int]:
        """States after each step of the cheapest way from ``first`` to ``last``, or to the conversation's end."""
        cost, back = np.full(4, np.inf), []
        cost[first] = 0
        for step in steps:
            through = cost[:, None] + step
            back.append(through.argmin(axis=0))
            cost = through.min(axis=0)
        states = [int((cost + self.end).argmin()) if last is None else last]
        for came in back[:0:-1]:
            states.append(int(came[states[-1]]))
        return states[::-1]


def _segments(key: pd.Series) -> list[tuple[int, int]]:
    edges = np.flatnonzero((key != key.shift()).to_numpy())
    return list(zip(edges, [*edges[1:], len(key)], strict=True))


ENDS = "conv string, part bigint, place bigint, matrix array<double>"
BORDERS = "part bigint, place bigint, enter int, leave int, last boolean"


def _ends(group: pd.DataFrame, part: str, steps: np.ndarray, costs: Costs) -> pd.DataFrame:
    """Matrices of a sorted group's first and last conversation; those between lie in the group as a whole."""
    found = _segments(group["conv"])
    out = [
        (group["conv"].iat[a], int(group[part].iat[a]), int(group["place"].iat[a]), costs.over(steps[a:b]).ravel().tolist())
        for a, b in (found if len(found) < 3 else [found[0], found[-1]])
    ]
    return pd.DataFrame(out, columns=["conv", "part", "place", "matrix"])


def _ways(group: pd.DataFrame, borders: pd.DataFrame | None, steps: np.ndarray, costs: Costs):
    """(start, end, state before, states after each step, whether the conversation ends here) of a sorted group's conversations.

    ``borders`` has the states of the conversations that may reach beyond the group, by their first place.
    """
    known = {} if borders is None else {r.place: (r.enter, r.leave, r.last) for r in borders.itertuples()}
    for a, b in _segments(group["conv"]):
        enter, leave, last = known.get(group["place"].iat[a], (0, None, True))
        yield a, b, int(enter), costs.path(steps[a:b], int(enter), None if leave is None else int(leave)), bool(last)


def _under(grouped: GroupedData, borders: DataFrame | None, solve, schema: str) -> DataFrame:
    """``solve(group, its borders or None)`` for each group."""
    if borders is None:
        return grouped.applyInPandas(lambda group: solve(group, None), schema)
    return grouped.cogroup(borders.groupBy("part")).applyInPandas(solve, schema)


def _borders(rows: DataFrame, parts: int, costs: Costs, fan: int) -> DataFrame:
    """States before and after each of the ``rows``, the matrices of ``parts`` parts."""
    rows = save_and_reload(rows.withColumn("block", F.floor(F.col("part") / fan)), "chat-ends")
    matrices = lambda group: np.array(group["matrix"].tolist()).reshape(-1, 4, 4)

    def up(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        return _ends(group, "block", matrices(group), costs)

    def down(group: pd.DataFrame, borders: pd.DataFrame | None) -> pd.DataFrame:
        group = group.sort_values("place")
        out = []
        for a, b, enter, states, last in _ways(group, borders, matrices(group), costs):
            out += zip([enter, *states[:-1]], states, [False] * (b - a - 1) + [last], strict=True)
        enters, leaves, lasts = zip(*out, strict=True)
        return pd.DataFrame({"part": group["part"].to_numpy(), "place": group["place"].to_numpy(), "enter": enters, "leave": leaves, "last": lasts})

    grouped, blocks = rows.groupBy("block"), -(-parts // fan)
    above = _borders(grouped.applyInPandas(up, ENDS), blocks, costs, fan) if blocks > 1 else None
    return _under(grouped, above, down, BORDERS)


def repaired_turns(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    merge: float = MERGE, relabel: float = RELABEL, insert: float = INSERT, chunk: int = CHUNK, fan: int = FAN,
) -> DataFrame:
    """Per turn: conv, turn, role, action, new_role, inserted, appended, cost and its piece of the rendered chat.

    action is "start" or "merge" (into the turn before); inserted is the role of the empty turn put
    before it; appended lists the roles of empty turns behind a conversation's last turn. Turns
    are ordered by turn, then role and text; null turns come last. A null or unknown role is
    one that any new role costs the same. Null texts are empty. Rows without a conversation are one
    conversation. Pieces of a conversation, joined in this order (`place`), are its chat.
    """
    costs = Costs(merge, relabel, insert)
    kinds = dict(turns.dtypes)
    known = F.lower(F.trim(col(role_col)))
    rows = turns.select(
        F.coalesce(F.concat(F.lit("v"), col(conv_col).cast("string")), F.lit("n")).alias("conv"), col(turn_col).alias("turn"),
        col(role_col).alias("role"), F.coalesce(col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), known), F.lit(0)).cast("int").alias("r"),
    )
    numbered = number_rows(rows, ["conv", "turn", "role", "text"], "place").withColumn("chunk", F.floor((F.col("place") - 1) / chunk))
    numbered = save_and_reload(numbered.withColumn("turn", F.col("turn").cast("string")), "chat-turns")

    chunks = -(-(numbered.agg(F.max("place")).first()[0] or 0) // chunk)

    def up(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        return _ends(group, "chunk", costs.step[group["r"].to_numpy()], costs)

    def repair(group: pd.DataFrame, borders: pd.DataFrame | None) -> pd.DataFrame:
        group = group.sort_values("place")
        roles, texts = group["r"].to_numpy(), group["text"].to_numpy()
        cells: dict[str, list] = {c: [] for c in ("action", "new_role", "inserted", "appended", "cost", "piece")}
        for a, b, before, states, last in _ways(group, borders, costs.step[roles], costs):
            for i, state in enumerate(states):
                action, inserted = costs.how[int(roles[a + i]), before, state]
                final = last and a + i == b - 1
                appended = {1: ["user", "assistant"], 2: ["assistant"]}.get(state, []) if final else []
                cells["action"].append(action)
                cells["new_role"].append(ROLES[state - 1])
                cells["inserted"].append(ROLES[inserted - 1] if inserted else None)
                cells["appended"].append(appended)
                cells["cost"].append(float(costs.step[roles[a + i], before, state]) + (float(costs.end[state]) if final else 0.0))
                cells["piece"].append(_piece(texts[a + i], before, state, action, inserted, appended, final))
                before = state
        return group[["conv", "place", "turn", "role"]].assign(**cells)

    borders = None
    if chunks > 1:
        ends = numbered.select("conv", "chunk", "place", "r").groupBy("chunk").applyInPandas(up, ENDS)
        borders = _borders(ends, chunks, costs, fan)
    done = _under(
        numbered.groupBy("chunk"), borders, repair,
        "conv string, place bigint, turn string, role string, action string, new_role string, inserted string, "
        "appended array<string>, cost double, piece string",
    )
    value = F.when(F.col("conv") != "n", F.substring("conv", 2, F.length("conv")))
    return done.select(
        value.cast(kinds[conv_col]).alias(conv_col), F.col("turn").cast(kinds[turn_col]).alias(turn_col), "role", "place",
        "action", "new_role", "inserted", "appended", "cost", "piece",
    )


def _piece(text: str, before: int, state: int, action: str, inserted: int, appended: list[str], final: bool) -> str:
    """What a turn adds to the chat. Marks inside texts are broken up, so they can't pose as turns."""
    text = text.replace("<|", "< |")
    if action == "merge":
        out = "\n" + text
    else:
        out = "<|im_end|>\n" if before else ""
        if inserted:
            out += _empty(ROLES[inserted - 1])
        out += f"<|im_start|>{ROLES[state - 1]}\n{text}"
    return out + ("<|im_end|>\n" + "".join(map(_empty, appended)) if final else "")


def _empty(role: str) -> str:
    return f"<|im_start|>{role}\n<|im_end|>\n"


def rendered(turns: DataFrame, conv_col: str = "conv_id", **options) -> DataFrame:
    """(conv, chat): one row per conversation, as long as the conversation itself."""
    pieces = repaired_turns(turns, conv_col, **options)
    return pieces.groupBy(conv_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda p: p["piece"]), "").alias("chat")
    )

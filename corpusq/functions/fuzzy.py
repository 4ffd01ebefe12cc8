"""Longest common run of letters, in Arrow batches: what the JVM's functions cannot say. (Type hints of a pandas UDF must
be there at run time, so this module does not postpone them.)"""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def automaton(quote: str) -> tuple[list[dict[str, int]], list[int], list[int]]:
    """The suffix automaton of a text: of each state its steps by letter, its suffix link, and the length of its longest text.
    It has at most two states for each letter, and is made in time in proportion to the letters."""
    steps: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for letter in quote:
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and letter not in steps[at]:
            steps[at][letter] = new
            at = link[at]
        if at >= 0:
            to = steps[at][letter]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(steps)
                steps.append(dict(steps[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and steps[at].get(letter) == to:
                    steps[at][letter] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return steps, link, length


def longest_run(steps: list[dict[str, int]], link: list[int], length: list[int], text: str) -> int:
    """The longest run of letters of a text that the automaton's text has too: one step a letter, whatever the runs."""
    at = run = most = 0
    for letter in text:
        while at and letter not in steps[at]:
            at = link[at]
            run = length[at]
        if letter in steps[at]:
            at = steps[at][letter]
            run += 1
            most = max(most, run)
    return most


@F.pandas_udf(DoubleType())
def common_run(quote: pd.Series, text: pd.Series) -> pd.Series:
    """Length of the longest common run over the quote's length. Of quotes in a row that are the same, one automaton is made."""
    out, before, own = [], None, None
    for q, t in zip(quote, text, strict=True):
        if q and q != before:
            before, own = q, automaton(q)
        out.append(longest_run(*own, t) / len(q) if q else 0.0)
    return pd.Series(out, dtype="float64")

"""Sequence-similarity ratio (longest common blocks, ``2M/(a+b)``) on Arrow batches.

The only scalar Python UDFs of the package. They see distinct names or
already blocked name pairs, never fact rows. The functions are nested so that
they travel to the executors by value.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import functions as F


def pair_ratio(cutoff: float = 0.0):
    """UDF ``(a, b) -> ratio``; the ratio is not symmetric in its arguments.

    Pairs whose shared characters, in any order, cannot reach the cutoff get 0.
    The second text is prepared once for all its pairs in a batch.
    """

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        out, matcher = [0.0] * len(a), SequenceMatcher(None)
        second = b.to_numpy()
        for i in sorted(range(len(second)), key=second.__getitem__):
            if matcher.b != second[i]:
                matcher.set_seq2(second[i])
            matcher.set_seq1(a.iat[i])
            if not cutoff or matcher.quick_ratio() >= cutoff:
                out[i] = matcher.ratio()
        return pd.Series(out, dtype="float64")

    return ratio


def nearest_of(cutoff: float, n: int):
    """``mapInArrow`` function ``(name, candidate, bound) -> (name, candidate, ratio, rank)``: the ``n`` best at the cutoff.

    Rows come sorted by name, then falling bound and candidate; repeated ones count
    once. ``bound`` is never below the ratio, so a name is done when its n-th best
    is not below (bound, candidate) of the next row. Only those n are held.
    """

    def run(batches):
        from difflib import SequenceMatcher

        import pyarrow as pa

        matcher, of, last, done, best = SequenceMatcher(None), None, None, False, []

        def ranked():
            return [(of, candidate, ratio, i + 1) for i, (ratio, candidate) in enumerate(best)]

        def batch_of(rows):
            kinds = (pa.string(), pa.string(), pa.float64(), pa.int32())
            columns = zip(*rows) if rows else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["name", "candidate", "ratio", "rank"])

        for batch in batches:
            out = []
            for name, candidate, bound in zip(*(batch.column(c).to_pylist() for c in ("name", "candidate", "bound"))):
                if name != of:
                    out += ranked()
                    of, last, done, best = name, None, False, []
                    prepared = False
                if done or candidate == last:
                    continue
                last = candidate
                if len(best) == n and best[-1] >= (bound, candidate):
                    done = True
                    continue
                if not prepared:
                    matcher.set_seq2(name)
                    prepared = True
                matcher.set_seq1(candidate)
                least = best[-1][0] if len(best) == n else cutoff
                if bound >= cutoff and matcher.quick_ratio() >= least and (ratio := matcher.ratio()) >= least:
                    best.append((ratio, candidate))
                    best.sort(reverse=True)
                    del best[n:]
            if out:
                yield batch_of(out)
        if best:
            yield batch_of(ranked())

    return run


def closest_of(vocabulary: Sequence[str], cutoff: float):
    """UDF ``name -> (fix, conf)`` against a vocabulary that the caller holds.

    ``fix`` is the closest entry at ``cutoff`` or better, case-sensitive, of equal
    ones the larger text; ``conf`` compares the lower-cased texts. Entries are
    tried by falling bound (shared characters in any order, all entries at once by
    character counts), until the best found beats the bounds that are left.
    """
    words = [str(w) for w in vocabulary]

    @F.pandas_udf("fix string, conf double")
    def closest(names: pd.Series) -> pd.DataFrame:
        from difflib import SequenceMatcher

        import numpy as np

        letters = {c: k for k, c in enumerate(sorted(set("".join(words))))}
        counts = np.zeros((len(words), len(letters) + 1), "int32")
        for row, word in enumerate(words):
            for c in word:
                counts[row, letters[c]] += 1
        sizes = counts.sum(1)
        known: dict[str, tuple[str, float]] = {}

        def search(name: str) -> tuple[str, float]:
            own = np.zeros(len(letters) + 1, "int32")
            for c in name:
                own[letters.get(c, len(letters))] += 1
            total = np.maximum(sizes + len(name), 1)
            bounds = np.where(sizes + len(name) > 0, 2.0 * np.minimum(counts, own).sum(1) / total, 1.0)
            best, matcher = (cutoff, ""), SequenceMatcher(None, b=name)
            found = False
            for row in np.argsort(-bounds, kind="stable"):
                if bounds[row] + 1e-9 < best[0]:
                    break
                matcher.set_seq1(words[row])
                value = (matcher.ratio(), words[row])
                if value >= best if found else value[0] >= cutoff:
                    best, found = value, True
            if not found:
                return "Unknown", 0.0
            return best[1], SequenceMatcher(None, name.lower(), best[1].lower()).ratio()

        rows = []
        for name in names:
            if name not in known:
                known[name] = search(name)
            rows.append(known[name])
        return pd.DataFrame(rows, columns=["fix", "conf"])

    return closest

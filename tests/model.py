"""Plain-Python model of the mining semantics, used as a second oracle on small
hand-made inputs (edge cases the events fixture never produces)."""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations


def render(ix):
    return "[" + ", ".join(str(p) for p in ix) + "]"


def enumerate_sequences(occ):
    """occ rows: dicts with S_name, S_dimension, S_class, T_name, ix."""
    groups = defaultdict(list)
    for r in occ:
        if r["ix"]:
            groups[(r["S_class"], r["T_name"])].append(r)
    seqs = []
    for (cls, t), rows in groups.items():
        best = {}
        for r in rows:
            key = (r["ix"][0], r["S_name"], render(r["ix"]))
            d = r["S_dimension"]
            if d not in best or key < best[d][0]:
                best[d] = (key, r)
        picks = sorted(
            ((k[0], k[1], d, k[2]) for d, (k, _) in best.items())
        )  # (ord, S_name, S_dimension, T_indice)
        for size in range(1, len(picks) + 1):
            for combo in combinations(picks, size):
                steps = [((p[2], p[1]), p[0]) for p in combo]  # ((dimension, name), ord), in pick order
                seqs.append({"S_class": cls, "T_name": t, "items": tuple(i for i, _ in steps), "steps": steps})
    return seqs


def _cells(occ, dataset):
    cells = defaultdict(list)
    for r in occ:
        if r["T_name"] in dataset:
            cells[(r["S_class"], (r["S_dimension"], r["S_name"]), r["T_name"])].append(r["ix"])
    return cells


def verdict_presence(dataset, occ):
    """dataset: {T_name: class}. -> {(S_class, source series, items): (tp, fn, fp, tn, accuracy, tas)}"""
    cells = _cells(occ, dataset)
    out = {}
    for s in enumerate_sequences(occ):
        cls = s["S_class"]
        tp = fn = fp = tn = 0
        tas = []
        for t, tcls in dataset.items():
            entries, veto = [], False
            for item, order in s["steps"]:
                for ix in cells.get((cls, item, t), []):
                    if not ix:
                        veto = True
                    entries += [f"{order}_{p}" for p in ix]
            found = not veto and bool(entries)
            if tcls == cls:
                if found:
                    tp += 1
                    p = int(min(entries).split("_")[1])
                    tas = [max(tas[0], p)] if tas else [p]
                else:
                    fn += 1
            elif found:
                fp += 1
            else:
                tn += 1
        n = tp + fn + fp + tn
        out[(cls, s["T_name"], s["items"])] = (tp, fn, fp, tn, (tp + tn) / n, tas)
    return out


def verdict_ordered(dataset, occ):
    """-> {(S_class, items): (tp, fn, fp, tn, accuracy, tas)}"""
    cells = _cells(occ, dataset)
    out = {}
    seen = set()
    for s in enumerate_sequences(occ):
        key = (s["S_class"], s["items"])
        if key in seen:
            continue
        seen.add(key)
        cls = s["S_class"]
        tp = fn = fp = tn = 0
        tas = None
        for t, tcls in dataset.items():
            chain, found = [], True
            for item, _ in s["steps"]:
                rows = cells.get((cls, item, t), [])
                if not rows or any(not ix for ix in rows):
                    found = False
                    break
                pos = sorted({p for ix in rows for p in ix})
                nxt = [p for p in pos if not chain or p >= chain[-1]]
                if not nxt:
                    found = False
                    break
                chain.append(nxt[0])
            if tcls == cls:
                if found:
                    tp += 1
                    tas = chain if tas is None else [max(a, b) for a, b in zip(tas, chain)]
                else:
                    fn += 1
            elif found:
                fp += 1
            else:
                tn += 1
        n = tp + fn + fp + tn
        out[key] = (tp, fn, fp, tn, (tp + tn) / n, tas or [])
    return out

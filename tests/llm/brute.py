"""The operators said again in plain Python, by all pairs and all words."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd

from stratalens.llm import language, pii
from stratalens.llm.near_dedup import SHINGLE, THRESHOLD
from stratalens.llm.neighbours import K, exact
from stratalens.llm.suffix import MIN_WORDS


def brute_groups(pdf: pd.DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> dict[int, int]:
    """doc_id -> group_id by all pairs' exact Jaccard index over sets of word tuples."""
    sets = {}
    for i, t in zip(pdf.doc_id, pdf.text, strict=True):
        if t:
            w = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
            sets[i] = {tuple(w[j : j + shingle]) for j in range(max(1, len(w) - shingle + 1))} if w else {t}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and both / (len(sets[i]) + len(sets[j]) - both) >= threshold:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    found = {i: find(i) for i in ids}
    count = pd.Series(found).value_counts()
    return {i: g for i, g in found.items() if count[g] > 1}


def brute_repeats(rows: list[tuple[int, str | None]], length: int = MIN_WORDS) -> set[tuple[int, int, int, bool]]:
    """The same by a dictionary of all runs."""
    split = {i: re.findall(rb"[^\x00-\x20]+", t.encode()) for i, t in rows if i is not None and t}
    where: dict[tuple, set[int]] = {}
    for i, w in split.items():
        for k in range(len(w) - length + 1):
            where.setdefault(tuple(w[k : k + length]), set()).add(i)
    out = set()
    for i, w in split.items():
        for keep in (True, False):
            spans: list[list[int]] = []
            for k in range(len(w) - length + 1):
                docs = where[tuple(w[k : k + length])]
                if len(docs) > 1 and (min(docs) == i) == keep:
                    if spans and k <= spans[-1][1]:
                        spans[-1][1] = k + length
                    else:
                        spans.append([k, k + length])
            out |= {(i, a, b, keep) for a, b in spans}
    return out


def brute_neighbours(pdf: pd.DataFrame, k: int = K) -> dict[int, list[int]]:
    """vec_id -> neighbour_ids by all pairs' distances."""
    x, ids = np.stack(pdf.embedding.to_list()).astype(float), pdf.vec_id.to_numpy()
    out = {}
    for i in range(len(x)):
        d = exact(x, x[i])
        d[i] = np.inf
        out[int(ids[i])] = [int(ids[j]) for j in np.lexsort((ids, d))[: min(k, len(x) - 1)]]
    return out


def brute_languages(docs: list[tuple[int, str | None, str | None]], penalty: float = language.PENALTY) -> list[tuple]:
    """(doc_id, span, lang, start_word, end_word) by a Viterbi a document over scores counted word by word."""
    letter = lambda b: chr(b).isalpha() if b < 128 else True
    low = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())

    def bucket(word: bytes) -> list[int]:
        c = bytes([32]) + bytes(b if letter(b) else 32 for b in word) + bytes([32])
        return [(((c[i - 1] << 16 | c[i] << 8 | c[i + 1]) * 2654435761) & 0xFFFFFFFF) >> 18 for i in range(1, len(c) - 1) if c[i] != 32]

    def script(word: bytes) -> str:
        names = []
        for ch in word.decode("utf-8", "replace"):
            k = max(i for i, (start, _) in enumerate(language.RANGES) if start <= ord(ch))
            if language.RANGES[k][1]:
                names.append(language.RANGES[k][1])
        return next((x for x in names if x != "Latin"), "Latin" if names else "")

    words = lambda t: re.findall(rb"[^\x00-\x20]+", t.encode()) if t else []
    counts: dict[str, np.ndarray] = {}
    writes: dict[str, dict[str, int]] = {}
    for _, text, lang in docs:
        if lang is not None and text:
            n = counts.setdefault(lang, np.zeros(language.BUCKETS))
            w = writes.setdefault(lang, {})
            for x in words(text):
                np.add.at(n, bucket(low(x.decode())), 1)
                w[script(x)] = w.get(script(x), 0) + 1
    scores = {g: np.log((n + 0.5) / (n + 0.5).sum()) - math.log(1 / language.BUCKETS) for g, n in counts.items()}
    may = {g: {s for s, k in w.items() if s and k >= language.SHARE * max(sum(v for t, v in w.items() if t), 1)} for g, w in writes.items()}
    for s, gs in language.SCRIPTS.items():
        if not any(s in m for m in may.values()):
            for g in gs:
                may.setdefault(g, set()).add(s)
    every = sorted({*may, "und"})
    out: list[tuple] = []
    for i, text, _ in docs:
        ws = words(text)
        if not ws:
            out.append((i, 0, None, 0, 0))
            continue
        e = []
        for x in ws:
            s = script(x)
            fits = [g for g in every if s == "" or s in may.get(g, set())] or ["und"]
            b = bucket(low(x.decode()))
            e.append([(-0.001 if s == "" and g != "und" else 0.0) + (0.0 if g in fits else -1e6) + (float(sum(scores[g][k] for k in b)) if g in scores else 0.0) for g in every])
        best, back = list(e[0]), []
        for row in e[1:]:
            top = max(range(len(every)), key=lambda g: (best[g], -g))
            back.append([g if best[g] >= best[top] - penalty else top for g in range(len(every))])
            best = [max(best[g], best[top] - penalty) + row[g] for g in range(len(every))]
        state = max(range(len(every)), key=lambda g: (best[g], -g))
        labels = [state]
        for row in reversed(back):
            state = row[state]
            labels.append(state)
        labels.reverse()
        start, span = 0, 0
        for t in range(1, len(labels) + 1):
            if t == len(labels) or labels[t] != labels[start]:
                out.append((i, span, every[labels[start]], start, t))
                start, span = t, span + 1
    return out


def brute_private(docs: list[tuple[int, str | None]]) -> list[tuple]:
    """(doc_id, kind, start, end, probability) with one row for every span in the estimation, and no test of texts before the search."""
    rows = [(i, *p) for i, t in docs if t for p in pii.proposals(t)]
    texts = dict(docs)
    out: list[tuple] = []
    for kind in pii.KINDS:
        own = [r for r in rows if r[1] == kind]
        if own:
            v = [pii.votes(kind, texts[r[0]][r[2] : r[3]], r[4], r[5]) for r in own]
            x = np.array([pii.features(kind, texts[r[0]][r[2] : r[3]], r[4], r[5], u) for r, u in zip(own, v, strict=True)])
            ones = np.ones(len(own))
            soft, _, _ = pii.reliabilities(np.array(v), ones, kind in pii.CHECK_DIGITS)
            w = pii.logistic(x, soft, ones)
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            out += [(r[0], kind, r[2], r[3], round(float(q), 5)) for r, q in zip(own, p, strict=True)]
    return out

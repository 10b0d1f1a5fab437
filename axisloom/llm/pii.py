"""Personal data: exact base patterns, and a linear-chain conditional random field that adds spans.

The field labels blank-separated tokens O, B-kind or I-kind from hashed features of their word shapes
(collapsed and full shape, digit count, short words, neighbours' shapes), made on byte arrays. It is trained here,
from a small labelled table that :func:`labelled_table` makes by rule, by gradient ascent on the conditional
likelihood (forward-backward over the whole padded table at once). Decoding is Viterbi in numpy batches.

The chain covers every token of every text. A token whose score as O exceeds any other by more than all that
transitions could make up is O on the best path, whatever stands beside it; the path is looked for between such
tokens, over padded batches of like length, and is the best path of the whole chain. Decoded spans are kept
unless they can't be of their kind (digits, Luhn, parts at most 255, no at sign in any writing) or overlap a base span.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisloom.llm import common, words

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
FEATURE_BITS = 14
FEATURES = 1 << FEATURE_BITS

# Possessive: every pattern takes time linear in the text, and what they leave out can't match.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at)):
            yield begin, m.end()
            done = m.end()
        elif begin < at:
            done = max(done, at)  # what stands left of this sign can't begin an address any more
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, in order of start and then kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(a, 1, b) for a, b in _ips(text)]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(out)


# ---- the field


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("0") : ord("9") + 1] = ord("9")
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[0x80:] = 0x80
_SHAPE[[ord(c) for c in "[{<"]] = ord("(")
_SHAPE[[ord(c) for c in "]}>"]] = ord(")")
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?\"'"]] = True
_ALPHA = (_SHAPE == ord("a")) | (_SHAPE == ord("A"))
_ALPHA[0x80:] = False
_ALNUM = _ALPHA | (_SHAPE == ord("9"))
_OPENS, _SHUTS = np.zeros(256, bool), np.zeros(256, bool)
_OPENS[[ord(c) for c in "([{"]] = _SHUTS[[ord(c) for c in ")]}"]] = True
#: Multipliers of the parts of a feature; their first is also its kind's.
_PART = (np.random.default_rng(10).integers(0, 1 << 63, 24, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
NEAR = 2  # tokens on either side that features look at


def _inside(solid: np.ndarray, start: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """From the first to after the last solid byte of each token; nothing where there is none."""
    at = np.append(np.flatnonzero(solid), size)
    first = np.minimum(at[np.searchsorted(at, start)], end)
    last = at[np.maximum(np.searchsorted(at, end) - 1, 0)] + 1
    return first, np.where((last > first) & (last <= end), last, first)


def _token_facts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """By token: hashes of its shape and of the shape without repeats and without stops at its ends, its digits, its
    signs (@, bracketed at, bracketed dot, stops) and a hash of the word in it if that is a short one (else 0)."""
    shape, n = _SHAPE[data], len(data)
    keep = np.ones(n, bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[start] = True
    at = np.cumsum(keep)
    short = shape[keep]
    bare = words.segment_hashes(short, *_inside(~_STOP[short], at[start] - 1, at[end - 1], len(short)))
    count = lambda mask: (c := np.concatenate([[0], np.cumsum(mask)]))[end] - c[start]
    low = words.LOWER[data]
    opens = np.flatnonzero(_OPENS[data[: n - 3]]) if n > 3 else np.zeros(0, np.int64)
    said = np.zeros((2, n), bool)
    for row, word in zip(said, (b"at", b"dot"), strict=True):
        k = opens[opens + len(word) + 1 < n]
        row[k] = np.logical_and.reduce([low[k + 1 + i] == c for i, c in enumerate(word)]) & _SHUTS[data[k + 1 + len(word)]]
    signs = (count(data == ord("@")) > 0) + 2 * (count(said[0]) > 0) + 4 * (count(said[1]) > 0) + 8 * np.minimum(count(data == ord(".")), 4)
    first, last = _inside(_ALNUM[data], start, end, n)
    letters = np.concatenate([[0], np.cumsum(_ALPHA[data])])
    plain = (last - first < 5) & (letters[last] - letters[first] == last - first) & (last > first)
    word = np.where(plain, words.segment_hashes(low, first, last), np.uint64(0))
    return words.segment_hashes(shape, start, end), bare, np.minimum(count(shape == 57), 20).astype(np.uint64), signs.astype(np.uint64), word


def _features(data: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashed feature numbers of every token, a row for each feature; neighbours are those of its own text."""
    full, bare, digits, signs, word = _token_facts(data, start, end)
    n = len(start)
    same = {by: text[by:] == text[: n - by] for by in (1, 2)}

    def near(x: np.ndarray, by: int) -> np.ndarray:
        out = np.full(n, np.uint64(7919))
        k = abs(by)
        if k < n:
            a, b = (slice(0, n - k), slice(k, n)) if by > 0 else (slice(k, n), slice(0, n - k))
            np.copyto(out[a], x[b], where=same[k])
        return out

    def one(kind: int, *parts: np.ndarray) -> np.ndarray:
        sums = np.full(n, _PART[kind])
        for k, x in enumerate(parts):
            sums += x * _PART[20 + k]
        sums ^= sums >> np.uint64(32)
        return (sums * _PART[19] >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)

    at_dot = signs & np.uint64(7)
    before, after, d0, d1, w0, w1 = near(bare, -1), near(bare, 1), near(digits, -1), near(digits, 1), near(word, -1), near(word, 1)
    return np.stack([
        one(0, full), one(1, bare), one(2, digits, signs), one(3, word), one(4, before, bare), one(5, bare, after), one(6, near(bare, -2), before), one(7, after, near(bare, 2)),
        one(8, d0, digits, d1), one(9, w0, bare), one(10, bare, w1), one(11, w0, word, w1), one(12, near(at_dot, -1), at_dot, near(at_dot, 1)), one(13, at_dot, word),
    ])


def labelled_table(n: int = 1500, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """Sentences of tokens with labels, made by rule: entities in many writings among look-alikes."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    letters = lambda a, b: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(a, b)))
    octet = lambda: str(r.randint(0, 255))

    def word() -> str:
        x = r.choice([letters(1, 10), letters(1, 10), letters(2, 8).capitalize(), letters(2, 5) + "é" + letters(0, 4), letters(1, 5).upper(), letters(2, 6) + "-" + letters(2, 6), letters(1, 4) + "'" + letters(1, 6)])
        x = r.choice([x, x, x, r.choice(["at", "dot", "the", "de", "und", "que", "to", "a", "of", "in", "is", "on", "call", "mail", "or", "and"])])
        return r.choice(["", "", "", "", "(", '"']) + x + r.choice(["", "", "", "", ".", ",", ";", ":", ")", '"'])

    def card() -> str:
        body = d(15)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def cut(x: str, sep: str) -> str:
        return sep.join(x[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        who = r.choice([letters(2, 9), letters(2, 7) + "." + letters(2, 7), letters(2, 7) + d(2), letters(1, 2) + "_" + letters(2, 7), letters(3, 7).capitalize()])
        hosts = [letters(2, 9) + r.choice(["", "", "", d(1), "-" + letters(2, 5)]) for _ in range(r.choice([1, 1, 1, 2, 3]))] + [r.choice(["com", "org", "net", "de", "fr", "info", letters(2, 4)])]
        a, z = r.choice([("(", ")"), ("[", "]"), ("{", "}")])
        at = r.choice([f" {a}at{z} ", f"{a}at{z}", f" {a}at{z} ", f"{a}at{z}", f" {a}AT{z} ", f"{a}AT{z}", "@"])
        dot = r.choice([f" {a}dot{z} ", f"{a}dot{z}", ".", f" {a}DOT{z} "]) if at != "@" or r.random() < 0.5 else "."
        return who + at + dot.join(hosts)

    def phone() -> str:
        a, b, c = d(3), d(3), d(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{d(2)} {a} {b}{c}", f"1-{a}-{b}-{c}", f"({a}){b}-{c}", f"{a} {b} {c}", f"{a} {b}-{c}", f"0{d(3)} {d(3)} {d(4)}", f"00{d(2)} {d(3)} {d(6)}", f"0{d(2)}/{d(7)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"])

    def entity() -> tuple[str, str]:
        kind = r.choice((*KINDS, "email", "email", "phone"))
        if kind == "email":
            return email(), kind
        if kind == "ip":
            return ".".join(octet() for _ in range(4)) + r.choice(["", "", f":{r.randint(80, 9999)}", "/24"]), kind
        if kind == "card":
            x = card()
            return r.choice([x, cut(x, " "), cut(x, "-"), cut(x, "."), cut(x, "/")]), kind
        return phone(), kind

    def decoy() -> str:
        return r.choice([
            f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(1)}.{d(1)}.", f"version {d(1)}.{d(1)}.{d(1)}", f"{d(2)}:{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"{d(3)},{d(3)}.{d(2)}", f"{d(1)},{d(3)},{d(3)}",
            d(r.randint(1, 8)), f"{d(2)} {d(2)} {d(2)}", f"{d(3)} {d(3)}", f"{d(4)} {d(4)}", f"{d(1)} {d(3)} {d(3)}", f"{d(3)}-{d(3)}", f"{d(4)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", d(r.randint(17, 26)),
            "AKIA" + "".join(r.choice("ABCDEFG234567") for _ in range(16)), f"password={hashlib.md5(d(5).encode()).hexdigest()[:18]}", f'token = "{hashlib.sha1(d(5).encode()).hexdigest()}"', hashlib.sha1(d(5).encode()).hexdigest(),
            f"CC BY-NC {d(1)}.0.", f"({d(4)})", f"{d(3)}%", f"#{d(5)}", f"p. {d(3)}", f"{letters(2, 4)}{d(2)}", f"@{letters(3, 7)}", f"{d(1)}/{d(2)}", f"${d(3)}.{d(2)}", f"[{d(2)}]", f"{d(1)})", f"{letters(3, 8)} at {letters(3, 8)}", f"({letters(2, 4)}) {letters(3, 7)}", f"{letters(3, 7)} [{letters(2, 4)}]",
            f"a dot {letters(3, 7)}", f"https://{letters(3, 8)}.{letters(3, 6)}.com/{letters(2, 5)}?{letters(1, 2)}={d(2)}", f"www.{letters(3, 8)}.org", f"{letters(3, 8)}.{letters(2, 3)}", f"{letters(2, 5)}_{letters(2, 5)}({letters(1, 3)})", f"{letters(3, 6)}[{d(1)}]", "+ " + d(2), f"({letters(3, 6)})", "=====", "----", "*", f"{d(2)}.", f"{letters(2, 6)}***", f"{letters(2, 4)}.&&&", f"{letters(2, 6)}$$$", f"{letters(2, 6)}###", f"{letters(2, 6)}.{letters(2, 6)}", f"{letters(2, 6)}@",
        ])

    out = []
    for _ in range(n):
        tokens, labels = [], []
        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(0, 6)):
                tokens.append(word())
                labels.append("O")
            for _ in range(r.choice([0, 0, 0, 1, 1, 2])):  # two stand side by side
                text, kind = entity()
                front, back = r.choice([("", ""), ("", ""), ("", ""), ("", "."), ("", ","), ("<", ">"), ("", ";"), ('"', '"'), ("(", ")") if text[0] != "(" else ("", "!"), ("(", "),") if text[0] != "(" else ("", "?")])
                parts = (front + text + back).split(" ")
                tokens += parts
                labels += [f"B-{kind}"] + [f"I-{kind}"] * (len(parts) - 1)
            if r.random() < 0.5:
                parts = decoy().split(" ")
                tokens += parts
                labels += ["O"] * len(parts)
        if tokens:
            out.append((tokens, labels))
    return out


class Field:
    """Weights of features by label, and of label pairs."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move
        #: By label what transitions can at most give it above O, on both sides together.
        self.gain = (move - move[:, :1]).max(axis=0) + (move - move[:1]).max(axis=1)

    def scores(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, most: int = 1 << 15) -> np.ndarray:
        """Of every token by label; a few tokens at a time, with their neighbours."""
        out = np.empty((len(start), len(LABELS)), np.float32)
        for a in range(0, len(start), most):
            b = min(len(start), a + most)
            lo, hi = max(0, a - NEAR), min(len(start), b + NEAR)
            at = int(start[lo])
            features = _features(data[at : int(end[hi - 1])], start[lo:hi] - at, end[lo:hi] - at, text[lo:hi])[:, a - lo : b - lo]
            part = self.emit[features[0]]
            for k in range(1, len(features)):
                part += self.emit[features[k]]
            out[a:b] = part
        return out

    def decode(self, scores: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Most likely label of every token, by Viterbi over the chain of each text."""
        n = len(scores)
        path = np.zeros(n, np.int8)
        free = (scores - scores[:, :1] + self.gain >= -1e-3)[:, 1:].any(axis=1)  # may be other than O
        at = np.flatnonzero(free)
        if not len(at):
            return path
        head = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])])
        begin, end = at[head], np.append(at[np.flatnonzero(head)[1:] - 1], at[-1]) + 1
        left = (begin > 0) & (text[np.maximum(begin - 1, 0)] == text[begin])
        right = (end < n) & (text[np.minimum(end, n - 1)] == text[end - 1])
        for i, labels in enumerate(self.viterbi([scores[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], left, right)):
            path[begin[i] : end[i]] = labels
        return path

    def viterbi(self, chains: list[np.ndarray], left: np.ndarray, right: np.ndarray, batch: int = 512) -> list[np.ndarray]:
        """Best labels of chains of scores, in padded batches of like length; ``left`` and ``right``: an O stands beside."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(chains)
        order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
        at = 0
        while at < len(order):
            longest = len(chains[order[min(at + batch, len(order)) - 1]])
            take = order[at : at + max(1, min(batch, 200_000 // max(longest, 1)))]
            at += len(take)
            t = len(chains[take[-1]])
            if not t:
                continue
            scores = np.zeros((len(take), t, len(LABELS)), np.float32)
            length = np.array([len(chains[i]) for i in take])
            for k, i in enumerate(take):
                scores[k, : length[k]] = chains[i]
            back = np.zeros((len(take), t, len(LABELS)), np.int8)
            best = scores[:, 0] + self.move[0] * left[take][:, None]
            for s in range(1, t):
                ways = best[:, :, None] + self.move
                back[:, s] = ways.argmax(axis=1)
                best = np.where((s < length)[:, None], ways.max(axis=1) + scores[:, s], best)
            best = best + self.move[:, 0] * right[take][:, None]
            path = np.zeros((len(take), t), np.int8)
            rows = np.arange(len(take))
            now = best.argmax(axis=1)
            for s in range(t - 1, -1, -1):
                path[:, s] = now
                now = np.where((s < length) & (s > 0), back[rows, s, now], now)
            for k, i in enumerate(take):
                out[i] = path[k, : length[k]]
        return out


def tokenized(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begin, end, number of its text) of the blank-separated tokens of texts."""
    data, off = common.text_buffers(pa.array(texts, pa.large_string()))
    start, end, _, word_off = words.document_words(data, off, words.BLANK_WORDS)
    return data, start, end, np.repeat(np.arange(len(texts)), np.diff(word_off))


def train(table: list[tuple[list[str], list[str]]], rounds: int = 60, rate: float = 0.5, decay: float = 1e-5, move_decay: float = 3e-3, dropped: float = 0.4, seed: int = 12) -> Field:
    """Gradient ascent (with per-weight step sizes) on the mean conditional log-likelihood of the table.

    Transitions decay more than features do, so these say most of what can be said; that keeps chains short. In
    every round a share ``dropped`` of all features is left out, so that none is relied on alone.
    """
    r = np.random.default_rng(seed)
    number = {x: i for i, x in enumerate(LABELS)}
    rows, n_l = len(table), len(LABELS)
    t = max(len(x) for x, _ in table)
    made = _features(*tokenized([" ".join(x) for x, _ in table])).T
    feats = np.split(made, np.cumsum([len(x) for x, _ in table])[:-1])
    width = made.shape[1]
    x = np.zeros((rows, t, width), np.int32)
    y, on = np.zeros((rows, t), np.int64), np.zeros((rows, t), bool)
    for i, (f, (_, labels)) in enumerate(zip(feats, table, strict=True)):
        x[i, : len(f)], y[i, : len(f)], on[i, : len(f)] = f, [number[a] for a in labels], True
    emit, move = np.zeros((FEATURES, n_l), np.float32), np.zeros((n_l, n_l), np.float32)
    seen_emit, seen_move = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    flat = x[on].ravel()
    gold = np.eye(n_l, dtype=np.float32)[y] * on[..., None]
    gold_move = np.zeros((n_l, n_l))
    np.add.at(gold_move, (y[:, :-1][on[:, 1:]], y[:, 1:][on[:, 1:]]), 1)
    lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
    for _ in range(rounds):
        here = np.zeros((rows, t, width), np.float32)
        here[on] = (r.random((int(on.sum()), width)) >= dropped) / (1 - dropped)
        s = np.einsum("rtwl,rtw->rtl", emit[x], here)
        fwd, bwd = np.zeros((rows, t, n_l), np.float32), np.zeros((rows, t, n_l), np.float32)
        fwd[:, 0] = s[:, 0]
        for k in range(1, t):
            fwd[:, k] = np.where(on[:, k, None], lse(fwd[:, k - 1][:, :, None] + move, 1) + s[:, k], fwd[:, k - 1])
        for k in range(t - 2, -1, -1):
            bwd[:, k] = np.where(on[:, k + 1, None], lse(move + (s[:, k + 1] + bwd[:, k + 1])[:, None, :], 2), 0.0)
        whole = lse(fwd[:, -1], 1)
        p = np.exp(fwd + bwd - whole[:, None, None]) * on[..., None]
        pair = np.exp(fwd[:, :-1, :, None] + move + (s[:, 1:] + bwd[:, 1:])[:, :, None, :] - whole[:, None, None, None])
        g_move = (gold_move - (pair * on[:, 1:, None, None]).sum(axis=(0, 1))) / rows - move_decay * move
        step = ((gold - p)[on] / rows)[:, None, :] * here[on][..., None]
        step = step.reshape(-1, n_l)
        g_emit = np.column_stack([np.bincount(flat, step[:, c], FEATURES) for c in range(n_l)]) - decay * emit
        seen_emit += g_emit**2
        seen_move += g_move**2
        emit += rate * g_emit / np.sqrt(seen_emit)
        move += rate * g_move / np.sqrt(seen_move)
    return Field(emit.astype(np.float32), move.astype(np.float32))


@functools.cache
def field() -> Field:
    return train(labelled_table())


def _possible(kind: int, text: str) -> bool:
    """Whether a decoded span can be of its kind, by its numbers or its at sign."""
    numbers = re.findall("[0-9]+", text)
    digits = "".join(numbers)
    if kind == 1:
        return len(numbers) >= 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers[:4])
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 10 <= len(digits) <= 15
    return bool(re.search(r"@|[(\[{]at[)\]}]", text, re.IGNORECASE))


_FRONT, _BACK = frozenset(b"\"'<[{"), frozenset(b".,;:!?\"'>]}")
_PAIRS = {ord(")"): ord("("), ord("]"): ord("["), ord("}"): ord("{")}


def _trimmed(raw: bytes) -> tuple[int, int]:
    """Where a span begins and ends without quotes, stops and brackets that aren't closed or opened in it."""
    a, b = 0, len(raw)
    while a < b:
        if raw[b - 1] in _BACK and not (raw[b - 1] in _PAIRS and _PAIRS[raw[b - 1]] in raw[a : b - 1]):
            b -= 1
        elif raw[b - 1] == ord(")") and raw[a:b].count(b"(") < raw[a:b].count(b")"):
            b -= 1
        elif raw[a] in _FRONT or (raw[a] == ord("(") and raw[a:b].count(b"(") > raw[a:b].count(b")")):
            a += 1
        elif raw[a] == ord("(") and raw[b - 1] == ord(")") and raw.find(b")", a, b) == b - 1:
            a, b = a + 1, b - 1
        else:
            break
    return a, b


def _decoded(data: np.ndarray, off: np.ndarray, model: Field) -> Iterator[tuple[int, int, int, int]]:
    """(text, begin, kind, end) in code points of the spans that the field finds in neighbouring texts."""
    start, end, _, word_off = words.document_words(data, off, words.BLANK_WORDS)
    if not len(start):
        return
    text = np.repeat(np.arange(len(off) - 1), np.diff(word_off))
    path = model.decode(model.scores(data, start, end, text), text)
    on = path > 0
    goes_on = np.zeros(len(path), bool)
    goes_on[1:] = on[1:] & (path[1:] % 2 == 0) & ((path[1:] == path[:-1]) | (path[1:] == path[:-1] + 1)) & (text[1:] == text[:-1]) & on[:-1]
    first = np.flatnonzero(on & ~goes_on)
    rest = np.flatnonzero(~goes_on)
    after = np.append(rest, len(path))[np.searchsorted(rest, first) + 1]
    in_text, counted, before = -1, 0, 0  # code points of a text are counted on from span to span
    for i, j in zip(first.tolist(), after.tolist(), strict=True):
        raw = data[start[i] : end[j - 1]].tobytes()
        a, b = _trimmed(raw)
        kind = (int(path[i]) - 1) // 2
        if a < b and _possible(kind, raw[a:b].decode()):
            if text[i] != in_text:
                in_text, counted, before = int(text[i]), int(off[text[i]]), 0
            before += int(np.count_nonzero((data[counted : start[i] + a] & 0xC0) != 0x80))
            counted = int(start[i]) + a
            yield int(text[i]), before, kind, before + len(raw[a:b].decode())


def _apart(added: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The added spans that no base span reaches into; base spans are in the order of their starts."""
    starts, reach = [a for a, *_ in base], list(accumulate((b for *_, b in base), max))

    def free(a: int, b: int) -> bool:
        n = bisect_left(starts, b)
        return n == 0 or reach[n - 1] <= a

    return [s for s in added if free(s[0], s[2])]


def _spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_ASKS = np.zeros(256, bool)
_ASKS[[ord(c) for c in "0123456789@+"]] = True


def _found(column: pa.Array, model: Field) -> Iterator[tuple[int, str, list, list]]:
    """(row, text, base spans, added spans) of the texts that have any."""
    data, off = common.text_buffers(column)
    for i, j in common.groups(off):
        near = off[i : j + 1]
        asks = np.add.reduceat(np.append(_ASKS[data[near[0] : near[-1]]], False).astype(np.int64), near[:-1] - near[0])
        more: dict[int, list[tuple[int, int, int]]] = {}
        for d, a, kind, b in _decoded(data, near, model):
            more.setdefault(d, []).append((a, kind, b))
        for d in range(j - i):
            if near[d] < near[d + 1] and (asks[d] or d in more):
                text = column[i + d].as_py()
                base = base_spans(text)
                apart = _apart(more.get(d, []), base)
                if base or apart:
                    yield i + d, text, base, apart


def pii_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: counts and digest of the base spans, and all spans.

    ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` count base spans, ``n_added`` those that the field adds.
    Null and empty texts have no spans. Null keys and repeated rows are kept.
    """
    common.bounded_batches(docs.sparkSession)
    model = field()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "n_added", "base_sha256", "spans"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n = batch.num_rows
            counts, digest, spans = np.zeros((n, 5), np.int64), [empty] * n, [""] * n
            for i, _, base, more in _found(batch.column("text"), model):
                for _, k, _ in base:
                    counts[i, k] += 1
                counts[i, 4] = len(more)
                digest[i] = hashlib.sha256(_spell(base).encode()).hexdigest()
                spans[i] = _spell(sorted(base + more))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(counts[:, c]) for c in range(5)), pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(common.tidied(step), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:6]) + ", base_sha256 string, spans string")


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or stretch of overlapping spans, replaced by its first kind in brackets."""
    out, done = [], 0
    for a, k, b in sorted(spans):
        if a >= done:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def masked(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with all spans masked, and ``n_chars`` counted anew where the text changed."""
    common.bounded_batches(docs.sparkSession)
    model, names = field(), docs.columns
    schema = docs.schema

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            change = {i: mask(t, base + more) for i, t, base, more in _found(batch.column(text), model) if base or more}
            if change:
                at = names.index(text)
                columns = list(batch.columns)
                on = np.zeros(batch.num_rows, bool)
                on[list(change)] = True
                new = pa.array([change[i] for i in sorted(change)], columns[at].type)
                columns[at] = pa.compute.replace_with_mask(columns[at], pa.array(on), new)
                if n_chars in names:
                    c = names.index(n_chars)
                    columns[c] = pa.compute.replace_with_mask(columns[c], pa.array(on), pa.array([len(change[i]) for i in sorted(change)]).cast(columns[c].type))
                batch = pa.RecordBatch.from_arrays(columns, names=names)
            yield batch

    return docs.mapInArrow(common.tidied(step), schema)

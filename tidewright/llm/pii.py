"""Personal data: pattern rules plus a character BiLSTM-CRF that adds spans.

Rules find e-mail, IP, card and phone spans over the whole text, in time linear in its length.  The
model finds forms that they miss (national phone numbers, addresses with "at" and "dot" written out or
spaced, cards and IPs with other separators).  It reads windows around every digit, ``@`` and written-out
``at`` or ``dot``: a bidirectional LSTM gives each character a score for each tag (outside; begin or
inside a kind), scores of overlapping windows are averaged, and one Viterbi pass with the CRF's
transitions decodes each merged region (regions above ``PIECE`` characters in overlapping pieces that
are joined again).  Spans that overlap no rule span and whose mean tag probability reaches their kind's
threshold are added; the threshold is the least at which ``PRECISION`` of such spans were right on
labelled texts that training didn't see.

The model is trained in numpy from labelled spans: personal data of known kinds, half of them in forms
that the rules miss, and near misses (dates, versions, prices, tokens, long numbers) are written into
prose of at most ``SAMPLE_ROWS`` rows and into invented prose.  Without rows all prose is invented.

Nulls: a null text is empty.  A null ``doc_id`` is carried through; repeated rows are treated alike.
``mask`` replaces ``n_chars``, where there is such a column, by the new length.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)
EMBED, HIDDEN, SYMBOLS = 16, 24, 130
SIDE, WINDOW, STRIDE, PIECE = 24, 96, 48, 1024
#: Spans beyond the rules need this share of right ones on labelled texts, and at least this confidence.
PRECISION, LEAST, CALIBRATION = 0.99, 0.8, 800
#: Rows whose prose the training spans are written into, and the characters taken of each (training only).
SAMPLE_ROWS, SAMPLE_CHARS = 300, 20_000
EXAMPLES, EPOCHS, BATCH, RATE = 3840, 6, 64, 0.01

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[(\[{]at[)\]}]|[(\[{]dot[)\]}]|\b(?:at|AT|dot|DOT)\b")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if m and start < at:
            yield start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            # a failed domain's characters may be the next match's local part
            at = text.find("@", at + 1)


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def rule_spans(text: str) -> list[tuple[str, int, int]]:
    """Rule matches by kind as listed, then start."""
    out = [("email", a, z) for a, z in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


# ---------------------------------------------------------------- training data


def _invented(rng: random.Random, n: int) -> str:
    syllables = ["en", "th", "re", "ti", "on", "la", "é", "au", "sch", "in", "er", "de", "ou", "ñ", "ver", "and", "ta", "ó", "us", "ing"]
    out = []
    for _ in range(n):
        w = "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) if rng.random() < 0.9 else str(rng.choice(["at", "dot", "At", "a", "in", "the"]))
        w = w.upper() if rng.random() < 0.1 else w.capitalize() if rng.random() < 0.2 else w
        out.append(w + (str(rng.choice([",", ".", "!!", "***", "%%%", ":", ""])) if rng.random() < 0.3 else ""))
    return " ".join(out)


def carriers(texts: list[str], count: int = 4000) -> list[str]:
    """Pieces of prose without digits and ``@``, to write labelled spans into."""
    out = []
    for t in texts:
        out += [x for x in re.findall(r"[^0-9@]{24,160}", t[: 1 << 20])[:20] if x.strip()]
    random.Random(17).shuffle(out)
    return out[:count]


def _prose(rng: random.Random, texts: list[str]) -> str:
    if not texts or rng.random() < 0.3:
        return _invented(rng, rng.randrange(0, 6))
    words = texts[rng.randrange(len(texts))].split(" ")
    at = rng.randrange(max(1, len(words) - 1))
    return " ".join(words[at : at + rng.randrange(0, 7)])


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


def _letters(rng: random.Random, lo: int, hi: int) -> str:
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(lo, hi)))


def _personal(rng: random.Random, kind: str, plain: bool) -> str:
    """A span of a kind, in a form that the rules know (``plain``) or one that they miss."""
    pick = lambda *x: str(rng.choice(list(x)))
    if kind == "email":
        local = _letters(rng, 2, 10) + pick("", ".", "_", "-") + pick(_letters(rng, 1, 8), _number(rng, 2))
        host, top = _letters(rng, 2, 9) + pick("", "", _number(rng, 1)), pick("com", "org", "net", "co.uk", "example.com", "de", "fr", "es")
        if plain:
            return f"{local}@{host}.{top}"
        at = pick(" at ", " AT ", "(at)", " (at) ", "[at]", " [at] ", " @ ", "{at}", "@ ")
        dot = "." if at in ("(at)", "[at]", "{at}") and rng.random() < 0.5 else pick(" dot ", " DOT ", "(dot)", " (dot) ", "[dot]", " [dot] ", " . ")
        return f"{local}{at}{host}{dot}{top.replace('.', dot)}"
    if kind == "ip":
        parts = [str(rng.randrange(256)) for _ in range(4)]
        if plain:
            return ".".join(parts)
        if rng.random() < 0.25:
            return ":".join(f"{rng.randrange(1 << 16):x}" for _ in range(8))
        return pick("[.]", " . ", "(.)", "[dot]", " dot ").join(parts)
    if kind == "card":
        body = _number(rng, rng.randrange(15, 19))
        body += next(str(d) for d in range(10) if luhn(body + str(d)))
        sep = pick("", "", " ", "-") if plain else pick(".", "/", "  ", " - ", "_")
        return sep.join(body[i : i + 4] for i in range(0, len(body), 4))
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    if plain:
        return pick(f"+1 ({a}) {b}-{c}", f"+{a[0]}{a[1]} {b} {c}", f"+1-{a}-{b}-{c}", f"+{a}{b}{c}", f"+49 {a} {b}{c}")
    pairs = " ".join(_number(rng, 2) for _ in range(4))
    return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a[:2]} {_number(rng, 4)} {c}", f"0{a[0]} {pairs}", f"0{a}/{b}{c}", f"(0{a}) {b}{c}", f"001 {a} {b} {c}", f"0{a} {b} {c}")


def _near_miss(rng: random.Random) -> str:
    n = lambda k: _number(rng, k)
    hexes = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    kinds = [
        f"20{n(2)}-{n(2)}-{n(2)}", f"{n(2)}.{n(2)}.20{n(2)}", f"{n(1)}.{n(1)}.{n(1)}", f"v{n(1)}.{n(2)}.{n(1)}.{n(4)}", f"${n(3)}.{n(2)}", f"{n(2)}:{n(2)}:{n(2)}", n(rng.randrange(1, 9)), n(rng.randrange(20, 33)),
        f"@{_letters(rng, 3, 9)}", f"{n(3)},{n(3)},{n(3)}", f"{n(1)}+{n(1)}={n(1)}", f'token = "{hexes(rng.randrange(20, 50))}"', f"password={hexes(18)}", f"key: {hexes(32)}", f"page={n(1)}&ref={n(3)}", f"{n(4)}-{n(4)}",
        f"{n(1)}-{n(4)}-{n(4)}-{n(1)}", f"#{n(6)}", f"{n(3)}/{n(3)}", "@@ ", "at. at. at. at", "At, at", "at the", "at 5 o'clock", "dot, dot", f"{n(2)}%", f"({n(4)})", f"[{n(2)}]", f"{n(1)}.{n(6)}", f"{n(3)} {n(3)}", f"{n(2)} {n(2)} {n(2)}",
    ]
    return str(kinds[rng.randrange(len(kinds))])


def _ids(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    return np.where(code < 128, code, 128)


def labelled(count: int, seed: int, texts: list[str], spans: float = 0.5, plain: float = 0.4, length: int = 160) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, spans) with personal data and near misses written into prose."""
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        text, found = "", []
        while len(text) < length:
            text += _prose(rng, texts) + str(rng.choice([" ", " ", " ", "\n", ": ", ", "]))
            if rng.random() < spans:
                kind = KINDS[rng.randrange(len(KINDS))]
                span = _personal(rng, kind, rng.random() < plain)
                found.append((kind, len(text), len(text) + len(span)))
            else:
                span = _near_miss(rng)
            text += span + str(rng.choice([" ", " ", ". ", ", ", "\n"]))
        out.append((text, found))
    return out


def examples(count: int, seed: int = 3, texts: list[str] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, tags) of windows of ``WINDOW`` characters of labelled texts."""
    rng = random.Random(seed + 1000)
    x, y = np.full((count, WINDOW), SYMBOLS - 1), np.zeros((count, WINDOW), dtype=np.int64)
    for i, (text, spans) in enumerate(labelled(count, seed, list(texts))):
        tags = np.zeros(len(text), dtype=np.int64)
        for kind, a, z in spans:
            tags[a:z] = 2 + 2 * KINDS.index(kind)
            tags[a] -= 1
        cut = rng.randrange(0, len(text) - WINDOW + 1)
        own = tags[cut : cut + WINDOW].copy()
        if own[0] and own[0] % 2 == 0:  # a window may begin inside a span
            own[0] -= 1
        x[i], y[i] = _ids(text[cut : cut + WINDOW]), own
    return x, y


# ---------------------------------------------------------------- model


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, w: np.ndarray, keep: bool):
    """x (time, batch, in), w (in + hidden + 1, 4 hidden) -> hidden states, and what training needs."""
    steps, batch, _ = x.shape
    n = w.shape[1] // 4
    h, c = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
    out, memo = np.empty((steps, batch, n), np.float32), []
    wx, wh, b = w[: x.shape[2]], w[x.shape[2] : -1], w[-1]
    pre = x.reshape(-1, x.shape[2]) @ wx + b
    pre = pre.reshape(steps, batch, -1)
    for t in range(steps):
        z = pre[t] + h @ wh
        gates = _sigmoid(z[:, : 3 * n])
        i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
        g = np.tanh(z[:, 3 * n :])
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        if keep:
            memo.append((h, c, i, f, o, g, tc))
        c, h = c_new, o * tc
        out[t] = h
    return out, memo


def _lstm_back(x: np.ndarray, w: np.ndarray, memo: list, d_out: np.ndarray):
    n, inputs = w.shape[1] // 4, x.shape[2]
    dw, dx = np.zeros_like(w), np.empty_like(x)
    wx, wh = w[:inputs], w[inputs:-1]
    dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
    for t in range(len(x) - 1, -1, -1):
        h, c, i, f, o, g, tc = memo[t]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dw[:inputs] += x[t].T @ dz
        dw[inputs:-1] += h.T @ dz
        dw[-1] += dz.sum(axis=0)
        dx[t] = dz @ wx.T
        dh, dc = dz @ wh.T, dc * f
    return dw, dx


def emissions(model: dict, ids: np.ndarray) -> np.ndarray:
    """Tag scores (batch, time, tags) of windows (batch, time)."""
    x = model["emb"][ids.T]
    a, _ = _lstm(x, model["fwd"], False)
    b, _ = _lstm(x[::-1], model["bwd"], False)
    return (np.concatenate([a, b[::-1]], axis=2) @ model["out"][:-1] + model["out"][-1]).transpose(1, 0, 2)


def _marginals(score: np.ndarray, trans: np.ndarray):
    """Scaled forward-backward over (time, lane, tags): tag marginals and summed pair marginals."""
    move = np.exp(trans)
    local = np.exp(score - score.max(axis=2, keepdims=True))
    alpha, beta, scale = np.empty_like(local), np.ones_like(local), np.empty((*local.shape[:2], 1), local.dtype)
    now = local[0]
    for t in range(len(local)):
        now = local[t] if t == 0 else now @ move * local[t]
        scale[t] = now.sum(axis=1, keepdims=True)
        now = now / scale[t]
        alpha[t] = now
    for t in range(len(local) - 2, -1, -1):
        beta[t] = (local[t + 1] * beta[t + 1] / scale[t + 1]) @ move.T
    after = (local * beta / scale)[1:].reshape(-1, local.shape[2])
    return alpha * beta, move * (alpha[:-1].reshape(-1, local.shape[2]).T @ after)


@lru_cache(maxsize=4)
def train(texts: tuple[str, ...] = (), count: int = EXAMPLES, epochs: int = EPOCHS, seed: int = 3) -> dict:
    """Adam on the CRF's negative log-likelihood over spans written into ``texts``; then a confidence for each kind."""
    rng = np.random.default_rng(seed)
    x, y = examples(count, seed, texts)
    shape = {"emb": (SYMBOLS, EMBED), "fwd": (EMBED + HIDDEN + 1, 4 * HIDDEN), "bwd": (EMBED + HIDDEN + 1, 4 * HIDDEN), "out": (2 * HIDDEN + 1, TAGS), "trans": (TAGS, TAGS)}
    p = {k: rng.normal(0, 0.15, s).astype(np.float32) for k, s in shape.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(count)
        for lo in range(0, count, BATCH):
            xs, ys = x[order[lo : lo + BATCH]].T, y[order[lo : lo + BATCH]].T
            e = p["emb"][xs]
            a, ma = _lstm(e, p["fwd"], True)
            b, mb = _lstm(e[::-1], p["bwd"], True)
            h = np.concatenate([a, b[::-1]], axis=2)
            score = h @ p["out"][:-1] + p["out"][-1]
            tag, pair = _marginals(score, p["trans"])
            d, n = tag.astype(np.float32), xs.shape[1]
            d[np.arange(WINDOW)[:, None], np.arange(n)[None], ys] -= 1
            d /= n
            gold = np.zeros_like(pair)
            np.add.at(gold, (ys[:-1], ys[1:]), 1)
            dh = d @ p["out"][:-1].T
            grad = {"trans": (pair - gold) / n, "out": np.concatenate([np.einsum("tbh,tbk->hk", h, d), d.sum(axis=(0, 1))[None]])}
            grad["fwd"], da = _lstm_back(e, p["fwd"], ma, dh[:, :, :HIDDEN])
            grad["bwd"], db = _lstm_back(e[::-1], p["bwd"], mb, dh[::-1, :, HIDDEN:])
            grad["emb"] = np.zeros_like(p["emb"])
            np.add.at(grad["emb"], xs, da + db[::-1])
            step += 1
            for k in p:
                g = np.clip(grad[k], -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] -= (RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    p["least"] = thresholds(p, labelled(CALIBRATION, seed + 1, list(texts), spans=0.15))
    return p


def viterbi(score: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tag paths (time, lane) of scores (time, lane, tags)."""
    best, back = score[0], np.zeros(score.shape, dtype=np.int8)
    for t in range(1, len(score)):
        total = best[:, :, None] + trans[None]
        back[t] = total.argmax(axis=1)
        best = total.max(axis=1) + score[t]
    path = np.empty(score.shape[:2], dtype=np.int64)
    path[-1] = best.argmax(axis=1)
    lane = np.arange(score.shape[1])
    for t in range(len(score) - 1, 0, -1):
        path[t - 1] = back[t, lane, path[t]]
    return path


def regions(text: str) -> list[tuple[int, int]]:
    """Merged stretches of ``SIDE`` characters around every digit, ``@`` and written-out ``at`` or ``dot``."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        lo, hi = max(0, m.start() - SIDE), min(len(text), m.end() + SIDE)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(a, z) for a, z in out]


def _windows(a: int, z: int) -> list[tuple[int, int]]:
    starts = range(a, max(a + 1, z - (WINDOW - STRIDE)), STRIDE)
    return [(s, min(z, s + WINDOW)) for s in starts]


def _decode(model: dict, pieces: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(path, probability of its tags) of each piece: overlapping windows are scored, their scores averaged, one path decoded."""
    rows, where = [], []
    for g, piece in enumerate(pieces):
        ids = _ids(piece)
        for s, e in _windows(0, len(piece)):
            where.append((g, s, e))
            rows.append(np.pad(ids[s:e], (0, WINDOW - (e - s)), constant_values=SYMBOLS - 1))
    score = np.concatenate([emissions(model, np.array(rows[k : k + 256])) for k in range(0, len(rows), 256)])
    longest = max(map(len, pieces))
    total, times = np.zeros((longest, len(pieces), TAGS), np.float32), np.zeros((longest, len(pieces), 1), np.float32)
    for (g, s, e), own in zip(where, score):
        total[s:e, g] += own[: e - s]
        times[s:e, g] += 1
    total /= np.maximum(times, 1)
    total[..., 1:] -= 1e4 * (times == 0)  # behind a piece's end stands nothing
    path = viterbi(total, model["trans"])
    lanes = np.flatnonzero(path.any(axis=0))
    sure = np.ones(path.shape, np.float32)
    if len(lanes):
        tag, _ = _marginals(total[:, lanes], model["trans"])
        sure[:, lanes] = np.take_along_axis(tag, path[:, lanes, None], axis=2)[..., 0]
    return [(path[: len(p), g], sure[: len(p), g]) for g, p in enumerate(pieces)]


def _pieces(a: int, z: int) -> list[tuple[int, int, int, int]]:
    """(start, end, first kept, last kept) parts of a region of at most ``PIECE`` characters that overlap by a window."""
    if z - a <= PIECE:
        return [(a, z, a, z)]
    out, at = [], a
    while at < z:
        lo, hi = max(a, at - WINDOW // 2), min(z, at + PIECE - WINDOW // 2)
        out.append((lo, hi, at, hi if hi == z else hi - WINDOW // 2))
        at = out[-1][3]
    return out


def tagged(model: dict, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
    """Spans decoded by the model in each text, with their mean tag probability."""
    found: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    jobs = sorted(((i, *p) for i, t in enumerate(texts) for a, z in regions(t) for p in _pieces(a, z)), key=lambda j: j[2] - j[1])
    paths: dict[int, list] = {}
    at = 0
    while at < len(jobs):
        end = at + 1
        while end < len(jobs) and (end - at + 1) * (jobs[end][2] - jobs[end][1]) <= 400 * WINDOW:
            end += 1
        for (i, lo, _, first, last), (path, sure) in zip(jobs[at:end], _decode(model, [texts[j[0]][j[1] : j[2]] for j in jobs[at:end]])):
            if path.any():
                paths.setdefault(i, []).append((first, path[first - lo : last - lo], sure[first - lo : last - lo]))
        at = end
    for i, parts in paths.items():
        open_at = None  # (kind, start, sum, characters)
        before = -1
        for first, path, sure in sorted(parts, key=lambda p: p[0]):
            if open_at and first != before:
                found[i].append((KINDS[open_at[0]], open_at[1], before, open_at[2] / open_at[3]))
                open_at = None
            for t in np.flatnonzero(np.append(path, 0) | np.append(0, path)).tolist():
                tag = path[t] if t < len(path) else None
                if tag is None:
                    break
                kind = (tag - 1) // 2 if tag else None
                if open_at and (kind != open_at[0] or tag % 2 == 1):
                    found[i].append((KINDS[open_at[0]], open_at[1], first + t, open_at[2] / open_at[3]))
                    open_at = None
                if tag:
                    open_at = (kind, open_at[1], open_at[2] + sure[t], open_at[3] + 1) if open_at else (kind, first + t, float(sure[t]), 1)
            before = first + len(path)
        if open_at:
            found[i].append((KINDS[open_at[0]], open_at[1], before, open_at[2] / open_at[3]))
    return found


def thresholds(model: dict, known: list[tuple[str, list]]) -> dict[str, float]:
    """Least confidence of each kind at which spans beyond the rules reach ``PRECISION`` on labelled texts."""
    out, seen = {}, {k: [] for k in KINDS}
    for (text, spans), got in zip(known, tagged(model, [t for t, _ in known])):
        base = rule_spans(text)
        for kind, a, z, sure in got:
            if not any(a < e and s < z for _, s, e in base):
                seen[kind].append((sure, any(kind == k and a < e and s < z for k, s, e in spans)))
    for kind, rows in seen.items():
        rows.sort(reverse=True)
        right = np.cumsum([ok for _, ok in rows]) / np.arange(1, len(rows) + 1)
        good = np.flatnonzero(right >= PRECISION)
        out[kind] = max(LEAST, float(rows[good[-1]][0])) if len(good) else 2.0
    return out


def all_spans(model: dict, texts: list[str]) -> list[tuple[list, list]]:
    """(rule spans, all spans) of each text: rule spans stay, model spans that overlap none of them are added."""
    out = []
    for text, extra in zip(texts, tagged(model, texts)):
        base = rule_spans(text)
        more = []
        for kind, a, z, sure in extra:
            own = text[a:z].strip(" \n\t.,;:")
            a = text.index(own, a) if own else z
            z = a + len(own)
            if own and sure >= model["least"][kind] and not any(a < e and s < z for _, s, e in base):
                more.append((kind, a, z))
        out.append((base, sorted({*base, *more}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


def sample(docs: DataFrame) -> tuple[str, ...]:
    """Prose of ``SAMPLE_ROWS`` rows, the first by a hash of their text, to train in."""
    rows = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null")
    # about three times the rows go on to be ordered, so that what reaches the driver doesn't grow with the table
    share = min(1 << 30, -(-3 * SAMPLE_ROWS * (1 << 30) // max(1, docs.count())))
    rows = rows.select(F.xxhash64("text").alias("h"), F.substring("text", 1, SAMPLE_CHARS).alias("text")).filter(F.pmod("h", F.lit(1 << 30)) < share)
    return tuple(carriers([r["text"] for r in rows.orderBy("h", "text").limit(SAMPLE_ROWS).collect()]))


def _text(spans: list) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def find(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """Spans of every row of ``docs`` (doc_id, text, ...), by ``model`` or one trained for them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model or train(sample(docs)))  # under 100 kB

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                both = all_spans(shared.value, [t or "" for t in part.column("text").to_pylist()])
                counts = [[sum(s[0] == k for s in spans) for _, spans in both] for k in KINDS]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(_text(b).encode()).hexdigest() for b, _ in both], pa.string()), pa.array([_text(s) for _, s in both], pa.string())],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
                )

    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(sample(docs)))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.string()).to_pylist()
            for i, (_, spans) in enumerate(all_spans(shared.value, [t or "" for t in texts])):
                if spans:
                    out, last = [], 0
                    for k, a, z in sorted(spans, key=lambda s: (s[1], -s[2])):
                        if z <= last:
                            continue
                        out += [texts[i][last : max(a, last)], f"[{k.upper()}]"]
                        last = z
                    texts[i] = "".join(out) + texts[i][last:]
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(texts, pa.string()))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op5_pii(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Secret scan: patterns for the base findings, and a character convolutional
network in numpy over every other candidate with its surrounding context.

A candidate is what base findings leave of a run of ``A-Za-z0-9+/_.=-``, if that
is 16 characters or more, or 10 or more and not made of plain words (letters in
one case, or capitalised, between signs). The network slides over the whole
candidate in windows of ``INSIDE`` characters; it sees the window, 24
characters before and after it, and its length, digits, entropy and slashes:
fixed character features, one convolution of width 5, maximum over positions, a
dense layer. A span is a candidate of one window, or the windows in a row that
pass. The network is trained on labelled findings generated by rule
(``labelled``), calibrated on others by a logistic curve, and used with the
highest threshold that keeps ``RECALL`` of the calibration set's secrets.
Training takes seconds on the driver; the weights are some kilobytes in the
tasks' closure.
"""

from __future__ import annotations

import base64
import hashlib
import re
import string
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import slices, utf8

RECALL = 0.98
CONTEXT, INSIDE = 24, 48
LENGTH = 2 * CONTEXT + INSIDE
WIDTH, FILTERS = 5, 24
KINDS = ("assign", "access", "hex", "cnn")

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{10,}")
_PLAIN = re.compile(r"[+/_.=-]*(?:(?:[A-Z]?[a-z]*|[A-Z]+)(?:[+/_.=-]+|$))*")
SHORT, ANY = 10, 16  # lengths from which a run that isn't plain words, and any run, is judged
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, whole matches, in order."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Parts of runs to judge: what base findings leave of each."""
    out, k = [], 0
    order = sorted((a, z) for a, _, z in taken)
    for m in _RUN.finditer(text):
        at, end = m.start(), m.end()
        while k < len(order) and order[k][1] <= at:
            k += 1
        j = k
        while at < end:
            while j < len(order) and order[j][1] <= at:
                j += 1
            stop = min(end, max(at, order[j][0])) if j < len(order) else end
            if stop - at >= ANY or stop - at >= SHORT and not _PLAIN.fullmatch(text, at, stop):
                out.append((at, stop))
            at = order[j][1] if stop < end else end
    return out


def windows(s: int, e: int) -> list[tuple[int, int]]:
    """Stretches of a candidate that the network judges: all of it, the longer ones
    half over each other."""
    if e - s <= INSIDE:
        return [(s, e)]
    return [(a, a + INSIDE) for a in [*range(s, e - INSIDE, INSIDE // 2), e - INSIDE]]


# -- network ----------------------------------------------------------------

def _features() -> np.ndarray:
    f = np.zeros((129, 22))
    for i in range(128):
        c = chr(i)
        f[i, :14] = [c.islower(), c.isupper(), c.isdigit(), c in "abcdef", c.lower() in "aeiou", c == "=", c == ":",
                     c in "\"'`", c == "/", c == ".", c in "-_", c == "+", c.isspace(), i < 32 or not c.isalnum()]
    f[128, 14] = 1.0  # other characters
    f[:128, 16:] = np.random.default_rng(5).standard_normal((128, 6)) * 0.5
    return f


_CHAR = _features()


def encode(text: str, s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of a window and its context (129: padding), and features of
    the window as a whole."""
    run, before, after = text[s:e], text[max(0, s - CONTEXT):s], text[e:e + CONTEXT]
    codes = np.full(LENGTH, 129, np.int16)
    for at, part in ((CONTEXT - len(before), before), (CONTEXT, run), (CONTEXT + INSIDE, after)):
        codes[at:at + len(part)] = np.minimum(np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32), 128)
    n = len(run)
    p = np.bincount(np.frombuffer(run.encode(), np.uint8)) / n
    p = p[p > 0]
    whole = np.array([np.log(n), sum(map(run.count, string.digits)) / n, -(p * np.log2(p)).sum(), run.count("/") / n])
    return codes, whole


def _patches(codes: np.ndarray) -> np.ndarray:
    """Windows of ``WIDTH`` characters' features, one row each."""
    table = np.vstack([_CHAR, np.zeros((1, _CHAR.shape[1]))]).astype(np.float32)
    x = table[codes]
    x[:, CONTEXT:CONTEXT + INSIDE, 15] = 1.0
    x = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)
    return np.ascontiguousarray(x.transpose(0, 1, 3, 2)).reshape(len(codes), LENGTH - WIDTH + 1, -1)


def _forward(w: dict, codes: np.ndarray, whole: np.ndarray):
    a = _patches(codes) @ w["conv"] + w["conv_b"]
    at = a.argmax(1)
    top = np.maximum(np.take_along_axis(a, at[:, None, :], 1)[:, 0], 0)
    h = np.concatenate([top, (whole - w["mean"]) / w["sd"]], 1)
    hid = np.maximum(h @ w["one"] + w["one_b"], 0)
    return at, top, h, hid, hid @ w["two"] + w["two_b"]


def logits(w: dict, codes: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.concatenate([_forward(w, codes[i:i + 512], whole[i:i + 512])[-1] for i in range(0, len(codes), 512)])


def train(seed: int = 11, epochs: int = 6, rows: int = 8000) -> dict:
    """Weights, calibration (``scale``, ``shift``) and ``threshold``."""
    rng = np.random.default_rng(seed)
    codes, whole, y = labelled(rng, rows)
    cut = rows * 3 // 4
    d = _CHAR.shape[1] * WIDTH
    w = {"conv": rng.standard_normal((d, FILTERS)) * d ** -0.5, "conv_b": np.zeros(FILTERS),
         "one": rng.standard_normal((FILTERS + 4, 16)) * (FILTERS + 4) ** -0.5, "one_b": np.zeros(16),
         "two": rng.standard_normal(16) * 0.25, "two_b": np.zeros(())}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    fixed = {"mean": whole[:cut].mean(0), "sd": whole[:cut].std(0) + 1e-6}
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in w.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(cut)
        for i in range(0, cut, 64):
            b = order[i:i + 64]
            at, top, h, hid, z = _forward({**w, **fixed}, codes[b], whole[b])
            g = (1 / (1 + np.exp(-z)) - y[b]) / len(b)
            gh = np.outer(g, w["two"]) * (hid > 0)
            gt = (gh @ w["one"].T)[:, :FILTERS] * (top > 0)
            patch = _patches(codes[b])
            picked = np.take_along_axis(patch, at[:, :, None], 1)  # best window of each filter
            grad = {"two": hid.T @ g, "two_b": g.sum(), "one": h.T @ gh, "one_b": gh.sum(0),
                    "conv": np.einsum("nfd,nf->df", picked, gt), "conv_b": gt.sum(0)}
            step += 1
            for k, v in grad.items():
                m, s = moment[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                w[k] = (w[k] - 0.005 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    w.update(fixed)
    z, t = logits(w, codes[cut:], whole[cut:]), y[cut:]
    scale, shift = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(scale * z + shift, -30, 30)))
        scale -= 0.05 * ((p - t) * z).mean()
        shift -= 0.05 * (p - t).mean()
    p = np.sort(1 / (1 + np.exp(-(scale * z[t == 1] + shift))))
    w.update(scale=scale, shift=shift, threshold=float(p[int((1 - RECALL) * len(p))]))
    return w


def probability(w: dict, z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(w["scale"] * z + w["shift"])))


# -- labelled findings ------------------------------------------------------

def labelled(rng: np.random.Generator, rows: int):
    """Findings generated by rule, half of them secrets: credentials of several
    shapes as they stand in settings, headers, addresses and shell lines,
    against identifiers, paths, numbers, names and joined words."""
    letters, syllables = string.ascii_letters + string.digits, "ka lo mi tre sun ver at en on ing ti sha re or ou de la".split()

    def pick(xs):
        return xs[int(rng.integers(len(xs)))]

    def chars(alphabet, n):
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))

    def word():
        return "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))

    def prose(n):
        return " ".join(word() for _ in range(n))

    def secret():
        n = int(rng.integers(20, 48))
        key = pick([lambda: chars(letters, n), lambda: base64.b64encode(rng.bytes(n * 3 // 4)).decode(),
                    lambda: pick(["sk-", "ghp_", "xoxb-", "pk_live_", "glpat-"]) + chars(letters, n),
                    lambda: "eyJ" + chars(letters, 20) + "." + chars(letters, n) + "." + chars(letters, 24),
                    lambda: chars(string.ascii_uppercase + string.digits, n), lambda: chars(string.ascii_letters, n),
                    lambda: chars(letters, int(rng.integers(10, 16)) - 1) + chars(string.digits, 1),
                    lambda: chars("0123456789abcdef", 10 + n // 4), lambda: chars(string.ascii_lowercase + string.digits, n)])()
        return key, pick([f"{prose(2)} {pick(['key', 'auth', 'credential', 'private_key', 'access'])}{pick([' = ', '=', ': '])}",
                          "Authorization: Bearer ", f"export {word().upper()}_KEY=", f"{prose(3)} ", f'"{word()}": "',
                          f"curl -u {word()}:", f"https://{word()}:"]), pick([" " + prose(3), '"', "\n" + prose(2), "@" + word() + ".com"])

    def harmless():
        n = int(rng.integers(2, 7))
        run = pick([lambda: str(uuid.UUID(bytes=rng.bytes(16))), lambda: "/".join(word() for _ in range(n)) + "/v" + chars("0123456789", 2),
                    lambda: "-".join(word() for _ in range(n + 2)) + "-" + chars("0123456789", 2),
                    lambda: "2024-" + chars("0123456789", 2) + "-" + chars("0123456789", 2) + "T" + chars("0123456789", 6) + "Z",
                    lambda: word() + "_" + word() + "_" + word() + "_" + chars("0123456789", 3) + ".py",
                    lambda: "".join(word() for _ in range(4)) + chars("0123456789", 1),
                    lambda: ".".join(chars("0123456789", 3) for _ in range(5)) + "-rc" + chars("0123456789", 1),
                    lambda: chars("0123456789", 18) + "x", lambda: "=" * 14 + word() + chars("0123456789", 2) + "=" * 6])()
        if rng.random() < 0.3:
            run = pick([lambda: "-".join(word() for _ in range(n + 4)), lambda: "".join(word() for _ in range(9)), lambda: pick("=-._") * (20 + n),
                        lambda: "".join(word() for _ in range(9)).upper(), lambda: f"{word()}.{word()}.com/{word()}/{word()}?".rstrip("?"),
                        lambda: word() + str(int(rng.integers(1000, 9999999))), lambda: word() + "_" + word() + "_" + word(),
                        lambda: chars("0123456789", 10 + n), lambda: word().title() + word().title() + word().title()])()
        return run.ljust(SHORT, "0"), pick([prose(4) + " ", "id ", "see ", "file ", "(", "version ", "on "]), pick([" " + prose(3), ")", ".\n" + prose(2)])

    def inner():
        """A path with or without a secret in it: the window shows a part of both."""
        path = [pick(["/", ".", "-", "_", "="]).join(word() for _ in range(int(rng.integers(12, 20)))) for _ in range(2)]
        key = secret()[0] if rng.random() < 0.5 else ""
        sign = pick("/=.-_")
        run = path[0] + (sign + key + sign if key else sign) + path[1]
        at = len(path[0]) + 1
        if key:  # at least 16 characters of it, or all
            part = min(16, len(key))
            s = int(rng.integers(max(0, at + part - INSIDE), at + len(key) - part + 1))
        else:
            s = int(rng.integers(0, max(1, len(run) - INSIDE)))
        return prose(3) + " ", run, s, bool(key)

    codes, whole, y = [], [], np.zeros(rows)
    for i in range(rows):
        if rng.random() < 0.25:
            before, run, s, y[i] = inner()
            c, f = encode(before + run + " " + prose(2), len(before) + s, len(before) + min(len(run), s + INSIDE))
        else:
            y[i] = rng.random() < 0.5
            run, before, after = (secret if y[i] else harmless)()
            # a longer one is seen through one of its windows
            s, e = pick(windows(len(before), len(before) + len(run)))
            c, f = encode(before + run + after, s, e)
        codes.append(c)
        whole.append(f)
    return np.array(codes), np.array(whole), y


# -- scan -------------------------------------------------------------------

_TOKEN = np.zeros(256, bool)
_TOKEN[[ord(c) for c in string.ascii_letters + string.digits + "+/_.=-"]] = True
_UPPER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_SIGN[[ord(c) for c in string.digits + "+/_.=-"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _suspects(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows that can hold a finding: a run of ``ANY`` characters, one of ``SHORT``
    that isn't a word in one case or capitalised, or one of the words that an
    assignment starts with."""
    mask = np.zeros(len(data) + 2, np.int8)
    mask[1:-1] = _TOKEN[data]
    step = np.diff(mask)
    s, e = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = e - s >= SHORT
    s, e = s[long], e[long]
    signs, uppers = (np.concatenate([[0], np.cumsum(k[data], dtype=np.int64)]) for k in (_SIGN, _UPPER))
    inner = uppers[e] - uppers[s + 1]
    s = s[(e - s >= ANY) | (signs[e - 1] > signs[s]) | ((inner > 0) & (inner < e - s - 1))]
    # A run may span rows that touch; the rows from its start to its end count.
    at = [np.searchsorted(offs, s, side="right") - 1]
    inner = offs[1:-1]
    if len(inner):
        joint = inner[(inner > 0) & (inner < len(data))]
        joint = joint[_TOKEN[data[joint]] & _TOKEN[data[joint - 1]]]
        at += [np.searchsorted(offs, joint, side="right") - 1, np.searchsorted(offs, joint - 1, side="right") - 1]
    low = _LOWER[data].tobytes()
    hits = []
    for w in _WORDS:
        i = low.find(w)
        while i >= 0:
            hits.append(i)
            i = low.find(w, i + len(w))
    at.append(np.searchsorted(offs, np.array(hits, np.int64), side="right") - 1)
    return np.unique(np.concatenate(at)).astype(np.int64)


def _scan(w: dict):
    none = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for part in slices(batches):
            data, offs = utf8(part.column(0))
            n = part.num_rows
            found: dict[int, list] = {}
            extra: dict[int, list] = {}
            held: list[tuple] = []  # (row, candidate, window, codes, features)

            def judge():
                if not held:
                    return
                p = probability(w, logits(w, np.array([h[3] for h in held]), np.array([h[4] for h in held])))
                for (i, _, (s, e), _, _), v in zip(held, p.tolist()):
                    if v >= w["threshold"]:
                        spans = extra.setdefault(i, [])
                        if spans and spans[-1][2] >= s:  # windows in a row are one span
                            spans[-1] = (spans[-1][0], 3, e)
                        else:
                            spans.append((s, 3, e))
                held.clear()

            raw = data.tobytes()
            for i in _suspects(data, offs).tolist():
                text = raw[offs[i]:offs[i + 1]].decode("utf-8", "replace")
                base = found[i] = base_findings(text)
                for c in candidates(text, base):
                    for s, e in windows(*c):
                        held.append((i, c, (s, e), *encode(text, s, e)))
                        if len(held) >= 4096:
                            judge()
            judge()
            counts = np.zeros((4, n), np.int64)
            digest, spans = [none] * n, [""] * n
            for i in found:
                base = found[i]
                every = sorted(base + extra.get(i, []))
                for _, k, _ in every:
                    counts[k, i] += 1
                joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
                digest[i] = hashlib.sha256(joined.encode()).hexdigest()
                spans[i] = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in every)
            yield pa.RecordBatch.from_arrays(
                [part.column(1), *[pa.array(c) for c in counts], pa.array(digest), pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_cnn", "base_sha256", "spans"])
    return run


def scan(docs: DataFrame, model: dict | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_assign, n_access, n_hex, n_cnn,
    base_sha256, spans``. Spans are ``kind:start:end`` in code points, end
    exclusive, by start and then kind; the network's have kind ``cnn``. Null
    and empty texts have no findings. Repeated rows count each. Other columns of
    ``docs``, whatever their names, play no part."""
    w = model or train()
    rows = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.col(f"`{doc_id}`").alias("doc_id"))
    return rows.mapInArrow(_scan(w), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, "
                           "n_hex long, n_cnn long, base_sha256 string, spans string")

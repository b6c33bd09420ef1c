import hashlib
import re

import numpy as np
import pytest

from basketry.llm import secret_scan as S


@pytest.fixture(scope="module")
def model():
    return S.train()


def plain(text):
    """The base findings, by a plain reading of their patterns."""
    found = []
    for kind, pattern in enumerate((r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                                    r"AKIA[A-Z0-9]+", r"[0-9a-f]+")):
        for m in re.finditer(pattern, text):
            if (len(m[2]) >= 6) if kind == 0 else len(m[0]) >= (20, 24)[kind - 1]:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


TEXTS = [None, "", "no secrets here", "password: hunter2", "PASSWD = 'abc'", "Token=abcdef and secret : \"x/y+z_1.=-\" é AKIA" + "A1" * 8, "ſecret=abcdefg",
         "AKIAAKIA" + "B" * 8, "AKIA" + "B" * 20, "x" * 40 + "0123456789abcdef" * 2, "deadbeef" * 3, "ABCDEF" * 6, "é" * 30 + ' api_key="' + "0a" * 20 + '"',
         "token=short token=longenough", "secret=token=abcdef", "apikey\n=abcdefg", "to", "ken=abcdefgh", "passwordpassword=abcdefgh", "a" * 100_000 + " token = zzzzzz"]


def test_base_findings_and_rows(spark, docs_of, model):
    rows = list(enumerate(TEXTS)) + [(None, "token=abcdef"), (1, "")]
    got = S.scan(docs_of(rows).selectExpr("*", "1 AS spans", "2 AS n_hex"), model).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            continue
        base = plain(TEXTS[r.doc_id] or "") if r.doc_id != 1 else []
        joined = ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("cnn")) == joined
    assert S.scan(docs_of([]).limit(0), model).count() == 0


def test_suspects_leave_no_finding_out():
    rng = np.random.default_rng(0)
    alphabet = list("abcdef0123 =:\"'AKIZé\n.tokensr")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 80))) + str(rng.choice(["", "token=abcdef12", "f" * 30, "AKIA" + "Z" * 16, "to"])) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0] + [len(r) for r in raw])
    sure = set(S._suspects(np.frombuffer(b"".join(raw), np.uint8), offs).tolist())
    for i, t in enumerate(texts):
        base = plain(t)
        assert base == S.base_findings(t)
        if base or S.candidates(t, base):
            assert i in sure


def test_held_out_findings(model):
    codes, whole, y = S.labelled(np.random.default_rng(77), 1500)
    p = S.probability(model, S.logits(model, codes, whole)) >= model["threshold"]
    assert p[y == 1].mean() >= 0.96 and p[y == 0].mean() <= 0.02


def test_network_adds_spans(spark, docs_of, model):
    key = "ghp_" + "aB3dE5gH7jK9mN1pQ3sT5vW7xY9zA1bC"
    text = f"é Authorization: Bearer {key} end"
    r = S.scan(docs_of([(1, text)]), model).head()
    s = text.index(key)
    assert r.spans == f"cnn:{s}:{s + len(key)}" and r.n_cnn == 1


def test_gradients_train(model):
    assert 0 < model["threshold"] <= 1 and model["scale"] > 0


def spans_of(spark, docs_of, model, texts):
    got = {r.doc_id: r.spans for r in S.scan(docs_of(list(enumerate(texts))), model).collect()}
    return [[(k, int(s), int(e)) for k, s, e in (x.split(":") for x in got[i].split(",") if x)] for i in range(len(texts))]


def test_secrets_that_no_rule_sets_apart(spark, docs_of, model):
    """Letters alone, ten characters, what stands after a base finding, and the
    middle of a long run are all judged."""
    letters = "qWzXvKpLmRtYbNcGhJdFsQwErTyUiO"
    short = "x7Kp2Qv9Zr"
    ghp = "ghp_aB3dE5gH7jK9mN1pQ3sT5vW7xY9zA1bC"
    second = "AKIA" + "QWERTYUIOPASDFGH" + "/" + "wJalrXUtnFEMIK7MDENGbPxRfiCYzEXAMPLE8kEy"
    path = "/".join(["kalo", "mitre", "sunver", "entising", "share", "oroude", "lache", "momika"] * 2)
    texts = [f"Authorization: Bearer {letters} on", f'private_key: "{short}" ka', f"kalo {second} mi", f"see {path}/{ghp}/{path} end",
             "ka lo mitre " * 40, f"see {path} end"]
    got = spans_of(spark, docs_of, model, texts)
    for i, key in ((0, letters), (1, short), (3, ghp)):
        at = texts[i].index(key)
        assert any(k == "cnn" and s <= at + len(key) // 2 < e for k, s, e in got[i]), (i, got[i])
    at = texts[2].index("wJalr")
    assert any(k == "access" for k, _, _ in got[2]) and any(k == "cnn" and s <= at + 4 and e >= at + 30 for k, s, e in got[2]), got[2]
    assert got[4] == [] and got[5] == []


def test_recall_from_the_text_on(spark, docs_of, model):
    """Candidates, windows and network together, on findings made by another rule."""
    rng = np.random.default_rng(3)
    alphabet = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    keys = ["".join(rng.choice(alphabet, rng.integers(20, 60))) for _ in range(300)]
    got = spans_of(spark, docs_of, model, [f"ka lo auth_key = {k} mitre sun" for k in keys])
    found = sum(any(s < 17 + len(k) and e > 17 for _, s, e in g) for g, k in zip(got, keys))
    assert found >= 0.96 * len(keys)


def test_candidates_are_what_base_findings_leave():
    text = "AKIA" + "A1" * 8 + "/" + "b" * 20 + " token=abcdef=" + "c" * 16 + " Nevertheless plain-words. x7Kp2Qv9Zr"
    base = S.base_findings(text)
    parts = [text[s:e] for s, e in S.candidates(text, base)]
    assert parts == ["/" + "b" * 20, "x7Kp2Qv9Zr"]
    covered = {k for s, e in S.windows(5, 5 + 1000) for k in range(s, e)}
    assert covered == set(range(5, 1005))


def test_network_equals_a_plain_convolution(model):
    codes, whole, _ = S.labelled(np.random.default_rng(8), 12)
    table = np.vstack([S._CHAR, np.zeros((1, S._CHAR.shape[1]))])
    for c, f, z in zip(codes, whole, S.logits(model, codes, whole)):
        x = [[*table[k]] for k in c]
        for i in range(S.CONTEXT, S.CONTEXT + S.INSIDE):
            x[i][15] = 1.0
        top = []
        for j in range(S.FILTERS):
            best = max(sum(v * w for v, w in zip(sum(x[i:i + S.WIDTH], []), model["conv"][:, j])) + model["conv_b"][j]
                       for i in range(S.LENGTH - S.WIDTH + 1))
            top.append(max(best, 0.0))
        h = np.array([*top, *((f - model["mean"]) / model["sd"])])
        hid = np.maximum(h @ model["one"] + model["one_b"], 0)
        assert abs(hid @ model["two"] + model["two_b"] - z) < 1e-2

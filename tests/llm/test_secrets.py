import random
import re

from lectern.llm import secrets as S

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
BASE = (ASSIGN, re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"))
WEAK = [re.compile(p, re.A) for _, _, p in S.WEAK]
ROLE = [S.BASE_ROLES.get(k) or next(r for w, r, _ in S.WEAK if w == k) for k in S.ORDER]


def brute(text, scope=S.SCOPE):
    text = text or ""
    base = [(m.start(), k, m.end()) for k, (p, least) in enumerate(zip(BASE, (6, 20, 24)))
            for m in p.finditer(text) if len(m[2 if k == 0 else 0]) >= least]
    weak = [(m.start(), 3 + k, m.end()) for k, p in enumerate(WEAK) for m in p.finditer(text)]
    near = lambda a, b: (a[0] - scope <= b[2] <= a[0]) or (a[2] <= b[0] <= a[2] + scope)
    added = [w for w in weak if any(ROLE[w[1]] != ROLE[o[1]] and near(w, o) for o in base + weak)
             and not any(b[0] < w[2] and w[0] < b[2] for b in base)]
    return sorted(base), sorted(added)


def texts():
    rng = random.Random(9)
    key, name, url = "Zk9" * 13, "ASIA" + "Q7" * 6, "https://db.example.org:99/x"
    out = [None, "", "plain words only", "password=abc", "password = 'abcdef'", "PASSWD:\"x1+/_.=-y\"", "secret=token: abcdefgh",
           "AKIA" + "A" * 15, "AKIA" + "A" * 16, "f" * 23, "e" * 24, "é" * 9 + "a" * 30 + " ß " + "b" * 24,
           key, f"{name} {key}", f"{name}" + " " * 301 + key, f"{name}" + " " * 300 + key, f"{key} {url}", f"{url}",
           f"token={key} {url} {name}", "AKIA" + "B" * 20 + " " + key + " " + url, "api_key=api_key=api_key", "token==tokentoken",
           ("x " * 40_000) + f"{name} {key}", f"{key} " * 300 + url]
    bits = [key, name, url, "password: hunter22", "AKIA" + "C" * 16, "0123456789abcdef" * 2, "word", " " * 120, "\n", "é", "token=a", "AKIA", "="]
    return out + ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(1, 30))) for _ in range(200)]


def test_spans_equal_brute_force(documents):
    rows = [*enumerate(texts()), (None, "token=abcdef"), (3, "password=abc")]
    got = S.find_secrets(documents(rows, "row", "id", "base")).collect()
    plain = lambda spans: [tuple(s) for s in spans]
    told = sorted(((r["doc_id"], plain(r["base"]), plain(r["added"])) for r in got), key=repr)
    want = sorted(((i, *brute(t)) for i, t in rows), key=repr)
    assert told == want
    assert sum(len(a) for *_, a in want) > 100


def test_report_lists_kinds_in_order(documents):
    import hashlib

    text = f"{'e' * 24} password=hunter22 AKIA{'C' * 16}"
    r = S.secret_report(S.find_secrets(documents([(1, text), (2, None)]))).orderBy("doc_id").collect()
    listed = "hex:0:24,assign:25:42,access:43:63"
    assert r[0]["spans"] == listed and r[0]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
    assert tuple(r[0])[1:4] == (1, 1, 1) and r[1]["spans"] == "" and tuple(r[1])[1:4] == (0, 0, 0)


def test_empty_table(documents):
    assert S.find_secrets(documents([])).count() == 0

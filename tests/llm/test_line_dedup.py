import random

from lectern.llm import line_dedup as L


def made():
    rng = random.Random(8)
    syllables = "ka lo mi ne ru ta vo shi pe gu dar fen".split()
    line = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))
    pool = [line(rng.randint(8, 60)) for _ in range(60)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randint(1, 6)):
            text = rng.choice(pool)
            for _ in range(rng.choice([0, 0, 1, 2])):
                at = rng.randrange(len(text))
                text = text[:at] + rng.choice("xyzé") + text[at + 1:]
            lines.append(rng.choice(["", "  "]) + text)
        rows.append((i, "\n".join(lines)))
    base = line(120)
    rows += [(500 + i, base[:5 * i] + "Q" + base[5 * i + 1:]) for i in range(60)]
    return [*rows, (900, None), (901, ""), (902, "\n\n  \n"), (903, "ab"), (904, "ab\nabc"), (None, "ab"), (905, "x" * 50_000),
            (905, "x" * 50_000)]


def brute(rows):
    lines = [(i is None, i or 0, n, place, t.strip(" "), i) for place, (i, text) in enumerate(rows)
             for n, t in enumerate((text or "").split("\n"))]
    distinct = {}
    for x in lines:
        if x[4]:
            distinct.setdefault(x[4], len(distinct))
    sets = [{t[k:k + 8] for k in range(max(1, len(t) - 7))} for t in distinct]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for x in lines:
        if x[4]:
            groups.setdefault(find(distinct[x[4]]), []).append(x)
    out = []
    for x in lines:
        members = groups[find(distinct[x[4]])] if x[4] else [x]
        head = min(members, key=lambda m: (m[0], m[1], m[2]))
        out.append((x[5], x[2], head[5], head[2], len(members)))
    return sorted(out, key=repr)


def test_equals_brute_force(documents):
    rows = made()
    got = L.line_dedup(documents(rows, "line", "row", "kept", "id").repartition(6)).collect()
    told = [(r["doc_id"], r["line_no"], r["class_doc_id"], r["class_line_no"], r["class_size"]) for r in got]
    assert sorted(told, key=repr) == brute(rows)
    groups = {}
    for r in got:
        if r["class_size"] > 1:
            groups.setdefault((r["class_doc_id"], r["class_line_no"]), []).append(r["kept"])
    assert all(sum(k) == 1 for k in groups.values())
    assert all(r["kept"] for r in got if r["class_size"] == 1)


def test_shingles_across_stretches_are_all_found(spark):
    text = "".join(chr(97 + (i * i) % 26) for i in range(300))
    for n in (1, 7, 8, 9, 63, 64, 70, 71, 72, 128, 135, 300):
        df = spark.createDataFrame([(1, text[:n])], "doc_id int, text string")
        lines = L.lines_of(df, "doc_id", "text")
        import pyspark.sql.functions as F

        width = max(1, n - L.WIDTH + 1)
        want = {text[:n][i:i + L.WIDTH] for i in range(width)}
        h = spark.createDataFrame([(w,) for w in want], "s string").select(F.min(F.hash("s").bitwiseXOR(F.lit(L._MASKS[0]))))
        assert L.signatures(lines).count() == 1
        keys = L.signatures(lines).first()["keys"]
        assert len(keys) == L.BANDS and h.first()[0] is not None


def test_no_lines(documents):
    assert L.line_dedup(documents([])).count() == 0
    assert [r["kept"] for r in L.line_dedup(documents([(1, None)])).collect()] == [True]


def test_one_edit_in_a_short_line_is_caught(spark, tmp_path):
    from lectern.llm import queries

    rng = random.Random(3)
    rows, known = [], {}
    for n in range(40, 81):
        text = "".join(chr(0x4E00 + k) for k in rng.sample(range(5_000), n))  # no shingle twice
        at = rng.randrange(5, n - 5)
        rows += [(2 * n, text, "en", "s", n), (2 * n + 1, text[:at] + "7" + text[at + 1:], "en", "s", n)]
        known[2 * n + 1] = 2 * n if n >= 49 else 2 * n + 1
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["class_doc_id"] for r in got if r["doc_id"] % 2} == known
    assert all(r["kept"] == (r["doc_id"] == r["class_doc_id"]) for r in got)


def test_pairs_are_formed_by_sketches_and_tables_are_not_kept(spark, tmp_path):
    from lectern.sources.tables import SHUFFLE_CLEANUP, Scratch

    rng = random.Random(4)
    common = "".join(chr(0x4E00 + k) for k in range(60))
    rows = [(i, common + "".join(chr(0x5000 + rng.randrange(9_000)) for _ in range(60))) for i in range(300)]
    rows.append((300, rows[7][1][:100] + "7" + rows[7][1][101:]))
    lines = L.lines_of(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text")
    scratch = Scratch(spark, "test-lines", lean=True)
    classes = scratch.keep(L.signatures(lines, 5), "classes")
    pairs = L.close_across(classes.withColumn("g", classes["id"]), 0.8, scratch, 5).count()
    assert 1 <= pairs < 60  # keys hold some thousand pairs of lines that share their first half
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"
    assert L.most_differing(32, 0.8) == 15 and len(L.bands_of(5)) == 16 and max(map(max, L.bands_of(5))) == 31


def similar(a, b):
    x, y = ({t[k:k + 5] for k in range(max(1, len(t) - 4))} for t in (a, b))
    return 5 * len(x & y) >= 4 * len(x | y)


def test_width_5_equals_brute_force(documents):
    lines = sorted({t.strip(" ") for _, text in made() for t in (text or "").split("\n")} - {""})
    root = list(range(len(lines)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(lines)):
        for b in range(a):
            if similar(lines[a], lines[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = L.line_dedup(documents(list(enumerate(lines))).repartition(6), width=5).collect()
    assert {r["doc_id"]: r["class_doc_id"] for r in got} == {k: find(k) for k in range(len(lines))}


def test_parts_find_pairs_and_pass_over_unlike_ones(spark):
    from lectern.sources.tables import Scratch

    rng = random.Random(6)
    draw = lambda n: [chr(0x4E00 + rng.randrange(20_000)) for _ in range(n)]
    texts = []
    for _ in range(1_000):  # one pair of lines each, a tenth of whose shingles are others: similarity 0.8 and a little more
        one = draw(rng.choice([50, 100, 300]))
        two = list(one)
        for at in range(10, len(one) - 4, 50):
            two[at] = "7"
        texts += ["".join(one), "".join(two)]
    common = "".join(draw(60))
    texts += [common + "".join(draw(60)) for _ in range(1_000)]  # all share their first half
    lines = L.lines_of(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "doc_id", "text")
    scratch = Scratch(spark, "test-parts", lean=True)
    classes = scratch.keep(L.part_signatures(lines, 5), "classes")
    shared = L.shared_keys(classes, scratch)
    named = {r["id"]: r["doc_id"] for r in classes.join(lines, L.CLASS).select("id", "doc_id").collect()}
    pairs = [sorted((named[r["a"]], named[r["b"]])) for r in L.first_pairs(shared, classes).collect()]
    near = spark.createDataFrame([], "id long, component long")
    rest = [sorted((named[r["a"]], named[r["b"]])) for r in L.other_pairs(shared, classes, near, scratch).collect()]
    wanted = [[k, k + 1] for k in range(0, 2_000, 2) if similar(texts[k], texts[k + 1])]
    found = sum(p in pairs for p in wanted)
    assert len(wanted) > 900 and found >= 0.995 * len(wanted)
    assert sum(p[0] >= 2_000 for p in rest) < 200  # of 499,500 pairs of lines that share a half


def test_a_family_below_the_threshold_gives_few_pairs(spark):
    from lectern.sources.tables import Scratch

    rng = random.Random(9)
    base = [chr(0x4E00 + rng.randrange(20_000)) for _ in range(400)]
    texts = []
    for _ in range(120):  # any two share some 0.72 of their shingles
        own = list(base)
        for at in rng.sample(range(400), 14):
            own[at] = chr(0xAC00 + rng.randrange(9_000))
        texts.append("".join(own))
    texts += [texts[k][:200] + "7" + texts[k][201:] for k in range(40)]  # and some are copies but for one character
    wanted = {(a, b) for b in range(160) for a in range(b) if similar(texts[a], texts[b])}
    close = {(a, b) for b in range(160) for a in range(b) if (a, b) not in wanted}
    lines = L.lines_of(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "doc_id", "text")
    scratch = Scratch(spark, "test-family", lean=True)
    classes = scratch.keep(L.part_signatures(lines, 5), "classes")
    shared = L.shared_keys(classes, scratch)
    named = {r["id"]: r["doc_id"] for r in classes.join(lines, L.CLASS).select("id", "doc_id").collect()}
    held = L.texts_of(classes.select("id"), classes, lines)
    near = spark.createDataFrame([], "id long, component long")
    pairs = {tuple(sorted((named[r["a"]], named[r["b"]]))) for r in L.other_pairs(shared, classes, near, scratch, held).collect()}
    assert len(wanted) >= 40 and len(wanted - pairs) <= 0.01 * len(wanted)
    assert len(close) > 12_000 and len(pairs & close) < 600  # few of the pairs below the threshold are left
    sketches = {named[r["id"]]: r for r in L.odd_sketches(held, 5).collect()}
    sets = [{t[k:k + 5] for k in range(len(t) - 4)} for t in texts]
    for a, b in [*wanted, *close]:
        apart = sum(((x ^ y) & (1 << 64) - 1).bit_count()
                    for x, y in zip(sketches[a]["odd"], sketches[b]["odd"]))
        assert apart <= len(sets[a] ^ sets[b]) and sketches[a]["n"] == len(sets[a])

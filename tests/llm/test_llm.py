"""The operators of the subpackage against brute force, exact round trips and planted cases on small fixtures."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from orizuru.llm import charlm, encoding_repair, linking, lookalike, names, packing, pii, spelling, tokens, topn


# --- top rows
def brute_leaders(rows, n=5):
    out = set()
    by = {}
    for board, entry, r, rk, name in set(rows):
        if r is not None and r == r:
            by.setdefault(board, set()).add((entry, r, rk, name))
    for board, group in by.items():
        order = sorted(group, key=lambda x: (-x[1], x[2] is None, x[2] or 0, x[3] is None, (x[3] or "").encode("utf-8"), x[0]))
        out |= {(board, x[0]) for x in order[:n]}
    return out


def test_top_n_ties_nulls_and_hot_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "hot", "hot", None, "c" * 3000]), i, rng.choice([1.0, 2.0, 0.5, None, float("nan"), -0.0, 0.0]), rng.choice([1, 2, None]), rng.choice(["x", "あ", "𠮷", "", None])) for i in range(600)]
    rows += rows[:100]
    df = spark.createDataFrame([(*r, 1) for r in rows], "board string, entry_id bigint, r double, rk int, n string, `board2` int").repartition(7)
    got = [tuple(r) for r in topn.board_leaders(df).collect()]
    assert set(got) == brute_leaders(rows) and len(got) == len(set(got))
    assert topn.board_leaders(df.limit(0)).count() == 0


def test_top_n_across_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(f"g{i % 3}", i, float(i % 11), i % 2, "n") for i in range(500)]
        df = spark.createDataFrame(rows + rows[::3], "board string, entry_id bigint, r double, rk int, n string")
        assert {tuple(r) for r in topn.board_leaders(df).collect()} == brute_leaders(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


# --- look-alikes
@pytest.fixture(scope="module")
def former(spark):
    rng = random.Random(5)
    kana = "アカサタナハマヤラワロエトニヘベペ"
    texts = ["".join(rng.choice(kana) for _ in range(6)) + t for t in ("の力", "と入口", "・ハロー!", " -力編-", "への手紙", "の夕陽", " OVA", "の八月") for _ in range(40)]
    texts += ["Windmill of Kotoba Season 2", "Звезда", "Café Étude Über", "二重奏と工房"] * 20
    return lookalike.train(spark.createDataFrame([(t,) for t in texts], "text string"))


@pytest.mark.parametrize(
    "bad, good",
    [
        ("ﾀﾊﾞﾑ･ｶﾞｷﾞ！", "タバム・ガギ!"), ("ガキ", "ガキ"), ("Café", "Café"), ("Ｗｉｎｄ　２", "Wind 2"), ("Wind​mill of", "Windmill of"),
        ("Wіndmіll", "Windmill"), ("ΟVA", "OVA"), ("⼒編 ⽉", "力編 月"), ("サ力タ", "サカタ"), ("ビザ卜パポの旅人", "ビザトパポの旅人"), ("ブへピ", "ブヘピ"), ("ハロ―ワ", "ハローワ"), ("‐力編‐", "-力編-"),
    ],
)
def test_look_alikes_are_rewritten(former, bad, good):
    assert former.form(bad) == good
    assert former.form(good) == good


@pytest.mark.parametrize("text", ["", None, "その①½", "Звезда", "Ωメガ", "神社", "入口と力のカタ", "力と入口のエト", "黄昏へむかう", "Señorita Über", "ロンド・ハロー!", "夕陽の二重奏", "♥ ☆"])
def test_ordinary_texts_stay(former, text):
    assert former.form(text) == text


def test_classes_hold_transitively():
    classes = {m: root for root, members in lookalike.look_alikes().items() for m in members}
    assert classes["ｶﾞ"] == classes["ガ"] == classes["ガ"] == classes["ｶ゙"]
    assert classes["Ａ"] == classes["А"] == classes["Α"] == classes["A"]
    assert "①" not in classes and "神" not in classes
    rng = random.Random(1)
    for c in rng.sample([chr(o) for o in range(0x3041, 0x30FF)] + list("éÄñ"), 40):
        assert classes.get(unicodedata.normalize("NFD", c), c) == classes.get(c, c)


# --- wrong encodings
@pytest.fixture(scope="module")
def repairer(spark):
    rng = random.Random(2)
    kanji, kana = "山田高木川村中島石井佐藤鈴清水森林池橋阿部西東南北", "アイウエオカキクケコサシスセソタチツテトナニヌネノ"
    texts = {"".join(rng.choice(kanji) for _ in range(4)) for _ in range(800)} | {"".join(rng.choice(kana) for _ in range(5)) + "の" + "".join(rng.choice(kanji) for _ in range(2)) for _ in range(800)}
    texts |= {f"Café {a}{b}" for a in "ABCDEFG" for b in ("lune", "mer", "sol", "noir")} | {f"Über {a}a" for a in "BCDFGHJKLM"}
    return encoding_repair.train(spark.createDataFrame([(t,) for t in sorted(texts)], "text string")), sorted(texts)


@pytest.mark.parametrize("wrong, right", [("cp1252", "utf-8"), ("cp932", "utf-8"), ("mac_roman", "utf-8"), ("koi8_r", "utf-8"), ("latin-1", "euc_jp"), ("cp850", "utf-8"), ("latin-1", "cp932")])
def test_garbled_texts_are_found_and_restored(repairer, wrong, right):
    fixed, texts = repairer
    rng, hits, whole = random.Random(4), 0, 0
    tried = 0
    for t in rng.sample([x for x in texts if not x.isascii() and not x.startswith(("C", "Ü"))], 60):
        try:
            bad = t.encode(right).decode(wrong)
        except UnicodeDecodeError:
            continue
        tried += 1
        flag, restored, _ = fixed(bad)
        hits += flag
        whole += restored == t
    assert hits >= 0.9 * tried and whole >= 0.8 * tried


def test_clean_texts_are_kept(repairer, spark):
    fixed, texts = repairer
    assert sum(fixed(t)[0] for t in texts) <= 0.01 * len(texts)
    assert fixed(None)[0] is False and fixed("")[0] is False and fixed("plain")[0] is False
    assert fixed("���R��") == (True, None, None)
    twice = "高木田山".encode().decode("latin-1").encode().decode("latin-1")
    assert fixed(twice)[0]
    rows = spark.createDataFrame([("t", "1", "高木山田"), ("t", "2", "高木山田".encode().decode("latin-1")), ("t", "2", "高木山田".encode().decode("latin-1")), ("t", "3", None)], "tab string, rec_id string, text string")
    assert {r.rec_id for r in encoding_repair.repair(rows, ["tab", "rec_id"], "text", fixed).collect()} == {"2"}


def test_margin_is_validated_on_all_texts(repairer, spark):
    fixed, texts = repairer
    rare = [t for t in texts if not t.isascii()]
    one = fixed.trial(rare)
    assert one[0] >= 2 * 0.9 * len(rare) and one[1] >= 0.5 * len(rare)
    parts = sum(fixed.trial(rare[k::3]) for k in range(3))
    assert (parts == one).all()  # tasks may hold any share of the texts
    seen = []
    many = spark.createDataFrame([("高木" + chr(0x4E00 + i),) for i in range(5000)], "text string")
    choose = encoding_repair.Repairer.choose
    encoding_repair.Repairer.choose = lambda self, said, ratio: (seen.append(said), choose(self, said, ratio))[1]
    try:
        encoding_repair.train(many)
    finally:
        encoding_repair.Repairer.choose = choose
    assert seen[0][0] > 2 * 4000  # clean and disturbed ones of more texts than a sample held


def test_long_and_late_garbling(repairer):
    fixed, texts = repairer
    rng = random.Random(8)
    clean = "、".join(rng.choice([t for t in texts if not t.isascii() and not t.startswith(("C", "Ü"))]) for _ in range(2500))[:10_000]
    for wrong in ("latin-1", "mac_roman"):
        said, restored, chain = fixed(clean.encode().decode(wrong))
        assert said and restored == clean and chain.endswith(">utf-8")
    head = "".join(rng.choice("山田高木川村") for _ in range(6000))
    said, restored, _ = fixed(head + "森本石川池橋阿部".encode("utf-8").decode("latin-1"))
    assert said and restored == head + "森本石川池橋阿部"
    assert not fixed(clean)[0]


def test_all_tails_are_scored_as_one_by_one(repairer):
    fixed, _ = repairer
    rng = random.Random(3)
    for _ in range(40):
        text = "".join(rng.choice("高木森本Café ") for _ in range(3)) + "".join(rng.choice("石川村中") for _ in range(4)).encode().decode(rng.choice(["latin-1", "mac_roman", "koi8_r", "cp850"]))
        held = encoding_repair._Texts([text], fixed.model)
        for chain in encoding_repair.CHAINS:
            for _, gain, start in zip(*(a.tolist() for a in held.best(*chain))):
                made = encoding_repair.made_by(text, start, chain)
                want = fixed.model.score(made) - fixed.model.score(text) - (encoding_repair.TAIL_COST if start else 0)
                if "\ufffd" not in made:
                    assert gain == pytest.approx(want, abs=1e-2)


# --- tokens
def test_token_round_trip_and_repair():
    enc = tokens.encoding()
    encoder = tokens.ChunkEncoder()
    rng = random.Random(9)
    alphabet = "ab 'relsvdtm  \n\t　é日本語123!?.."
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300)))
        assert encoder.encode(t) == enc.encode_ordinary(t)
    for t in ("a" * 3000, " " * 3000, "'" * 2000, "\n \n" * 500, "<|endoftext|>", "日本語。" * 700):
        ids = encoder.encode(t)
        assert ids == enc.encode_ordinary(t) and enc.decode(ids) == t
    assert encoder.reused
    passage = "".join(rng.choice(alphabet) for _ in range(4000))
    known = tokens.ChunkEncoder()
    known.encode(passage)
    known.encode("x y" + passage)
    assert known.reused > 0.8 * len(passage)  # a copied passage falls into the same chunks wherever it stands
    texts = [passage[:k] for k in range(0, 300, 7)] + [None, ""]
    ids, many = encoder.columns(texts)
    assert ids.to_pylist() == [enc.encode_ordinary(t or "") for t in texts] and many.to_pylist() == encoder.counts(texts).to_pylist()


def test_token_column(spark):
    df = spark.createDataFrame([(1, "hello"), (2, ""), (3, None), (4, "  "), (4, "  ")], "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in tokens.encode_column(df).collect()}
    assert got[2] == [] and got[3] == [] and got[1] == tokens.encoding().encode_ordinary("hello") and len(got[4]) > 0
    assert tokens.encode_column(df.limit(0)).count() == 0


# --- packing
def test_packing_is_whole_and_tight(spark):
    rng = np.random.default_rng(3)
    sizes = [int(x) for x in rng.integers(1, 900, 700)] + [0, 0, 2048, 2049, 5000]
    df = spark.createDataFrame(list(enumerate(sizes)) + [(0, sizes[0])], "doc_id bigint, n_tokens int")
    rows = packing.pack(df, shard_items=200, generations=10).collect()
    assert max_fill(rows) <= 2048
    total = {}
    for r in rows:
        total.setdefault(r.doc_id, []).append((r.start_at, r["size"]))
    assert set(total) == set(range(len(sizes)))
    for doc, parts in total.items():
        assert sum(s for _, s in parts) == sizes[doc] and (len(parts) == 1 or sizes[doc] > 2048)
        at = 0
        for start, size in sorted(parts):
            assert start == at
            at += size
    assert len({r.container_id for r in rows}) <= -(-sum(sizes) // 2048) + 3
    assert packing.pack(df.limit(0)).count() == 0
    assert packing.pack(spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, n_tokens int")).count() == 2


def test_packing_goes_on_until_nothing_is_gained(spark):
    rng = np.random.default_rng(5)
    sizes = [int(x) for x in rng.integers(700, 1100, 900)]
    rows = packing.pack(spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_tokens int"), shard_items=60, generations=5).collect()
    assert max_fill(rows) <= 2048 and {r.doc_id for r in rows} == set(range(900))
    order = sorted(range(900), key=lambda i: -sizes[i])
    assert len({r.container_id for r in rows}) <= len(packing.best_fit(np.array(sizes), order, [], 2048)) + 3


def max_fill(rows):
    fill = {}
    for r in rows:
        fill[r.container_id] = fill.get(r.container_id, 0) + r["size"]
    return max(fill.values())


def test_genetic_search_beats_or_equals_best_fit():
    rng = np.random.default_rng(8)
    sizes = rng.integers(300, 1100, 200)
    order = sorted(range(200), key=lambda i: -sizes[i])
    greedy = packing.best_fit(sizes, order, [], 2048)
    evolved = packing.evolve(sizes, [], 2048, 1, 60)
    assert len(evolved) <= len(greedy) and sorted(i for b in evolved for i in b) == list(range(200))


# --- names
def test_segment_join_finds_all_slips(spark):
    rng = random.Random(6)
    base = list({"".join(rng.choice("abcdef") for _ in range(rng.randint(4, 8))) for _ in range(120)})
    probes = set(base)
    for b in base[:60]:
        i = rng.randrange(len(b) - 1)
        probes |= {b[:i] + b[i + 1] + b[i] + b[i + 2 :], b[:i] + b[i + 1 :], b[:i] + "z" + b[i:], b[:i] + "z" + b[i + 1 :]}
    probes = sorted(probes)
    got = {(r.p, r.q) for r in names.segment_join(spark.createDataFrame([(p,) for p in probes], "p string"), spark.createDataFrame([(q,) for q in base], "q string")).collect()}
    want = {(p, q) for p in probes for q in base if p != q and len(p) > 2 and spelling.osa(p, q) == 1}
    assert got <= want and len(got) >= 0.99 * len(want)


def brute_osa(a, b):
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(2))
        for most in (1, 2):
            assert spelling.osa(a, b, most) == min(brute_osa(a, b), most + 1)


def test_spellings_of_planted_persons(spark):
    family, given = ["山田", "高木", "石川", "森本", "青島", "西村", "高本", "石木", "山島", "青村", "西川", "森田"], [("文織", "ふみおり"), ("桃香", "ももか"), ("直樹", "なおき"), ("鈴音", "すずね"), ("文香", "ふみか"), ("直音", "なおね"), ("桃樹", "ももき"), ("鈴織", "すずおり")]
    kana = dict(zip(family, ["やまだ", "たかぎ", "いしかわ", "もりもと", "あおしま", "にしむら", "たかもと", "いしぎ", "やましま", "あおむら", "にしかわ", "もりだ"]))
    truth, rows = {}, []

    def put(person, s, n):
        truth[s] = person
        rows.append((s, n))

    pick = random.Random(12)  # a family has some of the given names, as otherwise no spelling tells which reading is whose
    for i, f in enumerate(family):
        for g, r in pick.sample(given, 3):
            p = f + g
            put(p, p, 60)
            put(p, f + r, 4)
            if (i + len(r)) % 2:
                put(p, f"{g} {f}", 5)
                put(p, f"{kana[f]}・{r}", 3)
                put(p, spelling.romaji(kana[f]).upper() + " " + spelling.romaji(r).capitalize(), 3)
    put("高木文織", "高木文織", 60)
    for s in ("髙木文織", "高木文織(協力)", "高木織文", "高木文文織"):
        put("高木文織", s, 4)
    for g in ("Alexander", "Eleanor", "Robert"):
        for s in ("Gigihiro", "Zotepagu", "Nukayuri", "Merogomo"):
            put(g + s, f"{g} {s + g[0].lower() + 'a'}", 50)
    put("EleanorZotepagu", "Zotepaguea, Eleanor", 4), put("EleanorZotepagu", "E. Zotepaguea", 4), put("EleanorZotepagu", "Eleanor Zottepaguea", 5), put("EleanorZotepagu", "Ellie Zotepaguea", 3)
    for s in ("スタジオゾヒマヘゲ", "Studio Zohimahege Inc.", "(株)スタジオゾヒマヘゲ", "St. Zohimahege"):
        put("studio", s, 5)
    got = {(r.name_a, r.name_b) for r in names.pairs(names.classes(spark.createDataFrame(rows, "s string, n bigint"))).collect()}
    strings = sorted(truth)
    want = {(a, b) for a in strings for b in strings if a < b and truth[a] == truth[b]}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.03 * len(got)
    assert all(a < b for a, b in got)


def test_links_do_not_hang_on_row_counts(spark):
    rows = [(f"{g} {f}", 60) for g in ("Alexander", "Eleanor", "Robert") for f in ("Gigihiro", "Nukayuri", "Merogomo")]
    rows += [("Robert Nupozata", 42), ("R. Nupozata", 40), ("E. Gigihiro", 55), ("Eleanor Zotepagu", 140), ("Eleanor Zottepagu", 30)]
    rows += [("Robert Haposuke", 50), ("Ronald Haposuke", 48), ("R. Haposuke", 45), ("高木文織", 133), ("高木織文", 29)]
    got = {(r.name_a, r.name_b) for r in names.pairs(names.classes(spark.createDataFrame(rows, "s string, n bigint"))).collect()}
    assert {("R. Nupozata", "Robert Nupozata"), ("E. Gigihiro", "Eleanor Gigihiro"), ("Eleanor Zotepagu", "Eleanor Zottepagu"), ("高木文織", "高木織文")} <= got
    assert not any("Haposuke" in a for a, _ in got)  # two full names: the initial is no evidence


def test_brothers_and_sisters_are_no_nicknames(spark):
    families = ("Yamanobe", "Tokigawa", "Morishige", "Kanzakura", "Hirosada")
    rows = [(f"{g} {f}", 90 - 25 * k) for f in families for k, g in enumerate(("Kenji", "Akiko", "Hiroto", "Masami"))]
    found = {(r.name_a, r.name_b) for r in names.pairs(names.classes(spark.createDataFrame(rows, "s string, n bigint"))).collect()}
    assert found == set()
    for scale in (1, 10):
        more = rows + [(f"Peggy {f}", 9) for f in ("Nukayurino", "Gigihironi", "Zotepaguno")] + [(f"Margaret {f}", 60) for f in ("Nukayurino", "Gigihironi", "Zotepaguno")] + [(f"{g} {f}", 50) for g in ("Margaret", "Robert") for f in ("Arimo", "Besuto", "Cinolu")]
        df = spark.createDataFrame([(s, n * scale) for s, n in more], "s string, n bigint")
        got = {(r.name_a, r.name_b) for r in names.pairs(names.classes(df)).collect()}
        assert got == {(f"Margaret {f}", f"Peggy {f}") for f in ("Nukayurino", "Gigihironi", "Zotepaguno")}


def test_pointers_are_followed_to_their_end(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(11)] + [("x", "n3")], "p string, to string")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(12)] + [("x",), ("alone",)], "p string")
    assert {r.p: r.root for r in names._roots(nodes, chain).collect()} == {**{f"n{i}": "n11" for i in range(12)}, "x": "n11", "alone": "alone"}
    assert names._fold("甲", {(1, "甲"): "乙", (1, "乙"): "丙", (1, "丙"): "丁", (1, "丁"): "戊"}, False, 1) == "戊"
    assert names._fold("甲", {(1, "甲"): "乙", (1, "乙"): "甲"}, False, 1) in ("甲", "乙")


def test_readings_of_parts_of_any_length():
    rng = random.Random(4)
    first = dict(zip("山川田中村石森林島原", ["やま", "かわ", "た", "なか", "むら", "いし", "もり", "はやし", "しま", "はら"]))
    later = dict(zip("山川田中村石森林島原", ["やま", "かわ", "だ", "なか", "むら", "いし", "もり", "ばやし", "じま", "はら"]))
    spell = lambda part: "".join((first if not k else later)[c] for k, c in enumerate(part))
    parts = sorted({"".join(rng.choice("山川田中村石森林島原") for _ in range(n)) for n in (1, 2, 2, 3) for _ in range(40)})
    readings = spelling.Readings()
    readings.fit([(spell(p), [(p, 1.0), (rng.choice(parts), 0.5)]) for p in parts])
    assert sum(readings.read(p) == spell(p) for p in parts) >= 0.9 * len(parts)
    assert {len(p) for p in parts} == {1, 2, 3} and readings.read("") is None and readings.read("未") is None


def test_readings_are_fitted_on_all_spellings(spark):
    kanji, kana = [chr(0x4E00 + i) for i in range(3300)], "かきくけこさしすせそたちつてとなにぬねの"
    say = lambda i: kana[i % 20] + kana[i // 20 % 20] + kana[i // 400]
    spelled = spark.createDataFrame([(f"s{i}", i, say(i)) for i in range(3300)] + [("x", 0, None)], "s string, key int, kana string")
    held = [(i, c, 5) for i, c in enumerate(kanji)] + [(7, c, 1) for c in kanji[100:160]]  # one key with many names to choose from
    readings = names._fit(names._groups(spelled, spark.createDataFrame(held, "key int, part string, w bigint"), "key"))
    assert all(readings.read(c) == say(i) for i, c in enumerate(kanji))
    nothing = names._fit(names._groups(spelled.limit(0), spark.createDataFrame(held, "key int, part string, w bigint"), "key"))
    assert nothing.read("山") is None


def test_classes_without_pairs(spark):
    members = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "s string, class string")
    assert {(r.name, r["class"], r.links) for r in names.counted(members).collect()} == {("a", "x", 1), ("b", "x", 1), ("c", "y", 0)}


def test_names_of_nothing(spark):
    assert names.pairs(names.classes(spark.createDataFrame([], "s string, n bigint"))).count() == 0


# --- linking
def test_titles_are_read():
    read = linking.read_title
    assert read("ゴポケルヘの八月 第2期")[:3] == (["gopokeruhe", "八月"], 2, "tv")
    assert read("八月のごぽけるへ -海岸線編- Season2")[1] == 2 and "gopokeruhe" in read("八月のごぽけるへ -海岸線編- Season2")[0]
    assert read("劇場版 ロンドケラクサキ ♥")[2] == "film" and read("Kigegezege OVA")[2] == "ova" and read("星のモブドヌマ（2023年）")[4] == 2023
    assert read(None) == ([], 0, "", "", 0) and read("  ")[0] == []
    assert read("ハーモニー!2 公式")[1] == 2 and read("その①½ ♥")[0] == ["sono"]


def test_tables_follow_the_recall():
    rng = np.random.default_rng(1)
    for bits in (8, 13):
        tables = linking.tables_for(bits)
        a = rng.standard_normal((1500, linking.DIM))
        b = linking.SURE_COSINE * a / np.linalg.norm(a, axis=1, keepdims=True)
        other = rng.standard_normal(a.shape)
        other -= (other * a).sum(1, keepdims=True) / (a * a).sum(1, keepdims=True) * a
        b += np.sqrt(1 - linking.SURE_COSINE**2) * other / np.linalg.norm(other, axis=1, keepdims=True)
        planes = rng.standard_normal((linking.DIM, tables * bits))
        pa_, pb = (a @ planes).reshape(-1, tables, bits), (b @ planes).reshape(-1, tables, bits)
        apart = (pa_ > 0) != (pb > 0)
        least = np.zeros_like(apart)
        np.put_along_axis(least, np.argsort(np.abs(pa_), 2)[:, :, : linking.PROBES], True, 2)
        met = ((apart.sum(2) == 0) | ((apart.sum(2) == 1) & (apart & least).any(2))).any(1)
        assert met.mean() >= 0.87  # brute force over pairs of exactly this cosine; 0.9 is asked for


def test_comparisons_of_a_batch():
    import pyarrow as pa

    weights = np.ones(linking.VOCABULARY, np.float32)
    weights[5] = 3
    vectors = np.eye(linking.VOCABULARY, 8, dtype=np.float32)
    rows = {"tokens": ([[1, 2, 5], [], [3]], [[2, 5, 7], [1], [3]]), "season": ([1, 1, 2], [1, 2, 2]), "kind": ([1, 3, 2], [1, 4, 1]), "part": ([0, 4, 4], [0, 5, 4]), "numbers": ([0, 1, 1], [0, 1, 2]), "year": ([2000, 0, 1990], [2001, 1999, 2005]), "episodes": ([12, 0, 3], [12, 3, 5]), "studios": ([[1], [], [2]], [[1], [2], []]), "solid": ([1, 2, 3], [1, 5, 6]), "rare": ([9, 0, 4], [8, 0, 4])}
    arrays = {f"{side}_{c}": pa.array(v[k], pa.list_(pa.int32()) if isinstance(v[0][0], list) else pa.int32()) for c, v in rows.items() for k, side in enumerate("pe")}
    x = linking.compare(pa.RecordBatch.from_pydict(arrays | {"slip": pa.array([False, True, False])}), vectors, weights, weights)
    assert x[0, 1] == 1 and x[0, 2] == pytest.approx(4 / 6) and x[0, 3] == pytest.approx(4 / 5) and x[0, 9] == 1 and x[0, 13] == 1 and x[0, 19] == pytest.approx(1)
    assert x[1, 1] == 0 and x[1, 2] == 0 and x[1, 7] == 1 and x[1, 12] == 1 and x[1, 16] == 1 and x[1, 17] == 1 and x[1, 20] == 1
    assert x[2, 1] == 1 and x[2, 4] == 0 and x[2, 11] == 10 and x[2, 15] == 1 and x[2, 16] == 0


def test_walks_train_and_cluster(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        base = [linking.bucket(f"{i}-{k}") for k in range(4)]
        for v in range(4):
            rows.append((1, i * 10 + v, v, ["w"], sorted(set(base + [linking.bucket(f"x{rng.randrange(5)}")])), 1, 1, 0, 0, 2000, 12, [linking.bucket("studio")]))
    titles = spark.createDataFrame(rows, linking._TITLES)
    weights = linking._weights(titles)
    walks = linking._walks(titles, weights).cache()
    assert walks.count() > 0 and walks.where("size(next) = 0").count() == 0
    v = linking._skip_grams(walks, weights)
    again = linking._skip_grams(walks.repartition(3), weights)
    assert np.abs(v - again).max() <= 2e-4  # the same on any number of partitions
    near = np.mean([v[linking.bucket(f"{i}-0")] @ v[linking.bucket(f"{i}-1")] for i in range(60)])
    far = np.mean([v[linking.bucket(f"{i}-0")] @ v[linking.bucket(f"{(i + 7) % 60}-1")] for i in range(60)])
    assert near > far + 0.05


def test_walks_are_of_one_size(spark):
    tokens = {i: sorted({linking.bucket(f"{i}-{k}") for k in range(300)} | {linking.bucket("all")}) for i in range(20)}
    titles = spark.createDataFrame([(1, i, 0, ["w"], t, 1, 1, 0, 0, 2000, 12, []) for i, t in tokens.items()], linking._TITLES)
    walks = linking._walks(titles, linking._weights(titles)).collect()
    assert len(walks) == 20 * linking.RARE_TOKENS and {len(w.next) for w in walks} == {linking.PASSES}
    assert all(set(w.own) | set(w.next) | {w.over} <= set(tokens[i]) for w in walks for i in tokens if w.over in tokens[i])


def test_packed_lists_come_back():
    import pyarrow as pa

    lists = pa.array([[1, 65535], [], [7], [], [300, 2, 2]], pa.list_(pa.int32()))
    for part in (lists, lists.slice(1, 3), lists.slice(4), lists.slice(0, 0)):
        assert linking._lists_of(linking._bytes_of(part)).to_pylist() == part.to_pylist()
    assert linking._lists_of(linking._bytes_of(lists).slice(2, 3)).to_pylist() == lists.to_pylist()[2:]


def test_rounds_meet_each_key_once():
    for table_rows, name_rows, tables in ((10, 5, 4), (3_000_000, 9_000_000, 20), (600_000, 2_100_000, 17), (0, 0, 8), (2_000_001, 0, 3)):
        rounds = linking.rounds_of(table_rows, name_rows, tables)
        assert sorted(t for r in rounds for t in range(r.first, r.last)) == list(range(tables))
        of = {r.names[1] for r in rounds if r.names[2] > r.names[0]}
        assert len(of) == 1 and sorted(k for r in rounds for k in range(r.names[0], r.names[2])) == list(range(of.pop()))
        assert max((r.last - r.first) * table_rows for r in rounds) <= max(linking.ROUND_ROWS, table_rows)


def test_matches_leave_little_on_disk_and_hang_on_no_rounds(spark, tmp_path, monkeypatch):
    from pathlib import Path
    from urllib.parse import urlparse

    rng = random.Random(4)
    name = lambda: "".join(rng.choice("kstnhmrgzdbp") + rng.choice("aiueo") for _ in range(5))
    entries = [(i, f"{name()} {name()}".title(), None, None, [name().title()], 2000 + i % 20, "TV", 12, [f"Studio {i % 9}"]) for i in range(300)]
    pages = [(i, e[1], e[5], 12, "{}") for i, e in enumerate(entries)]
    pages += [(1000 + i, e[1][1] + e[1][0] + e[1][2:], e[5], 12, "{}") for i, e in enumerate(entries[:60])]
    spark.createDataFrame(pages, "page_id bigint, title string, year int, total_episodes int, staff string").write.parquet(f"{tmp_path}/seesaa_client.parquet")
    spark.createDataFrame(entries, "anilist_id bigint, title_romaji string, title_english string, title_native string, synonyms array<string>, year int, format string, episodes int, studios array<string>").write.parquet(f"{tmp_path}/anilist_client.parquet")
    shared = Path(urlparse(spark.sparkContext._jsc.sc().getCheckpointDir().get()).path) if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else None
    before = {p for p in shared.rglob("*") if p.is_file()} if shared else set()
    first = linking.match(spark, str(tmp_path))
    shared = Path(urlparse(spark.sparkContext._jsc.sc().getCheckpointDir().get()).path)
    assert sum(p.stat().st_size for p in shared.rglob("*") if p.is_file() and p not in before) < 100_000  # the result alone; all pairs and titles before
    rows = first.collect()
    assert sum(r.page_id == r.anilist_id for r in rows) >= 295
    monkeypatch.setattr(linking, "ROUND_ROWS", 500, raising=False)
    monkeypatch.setattr(linking, "tables_for", lambda bits: 4)
    few = linking.match(spark, str(tmp_path)).collect()
    monkeypatch.setattr(linking, "ROUND_ROWS", 10**9, raising=False)
    assert sorted(few) == sorted(linking.match(spark, str(tmp_path)).collect()) and few


# --- personal data
def test_candidates_and_places():
    t = "連絡はs.toganoo＠box.invalidまで。電話は(03) 0000-2233です。携帯（07000001893）に。送り先:〒000-7014 霞原府鏡浦市 中央区下三輪七丁目15番地。"
    spans = {(t[a:b], f) for a, b, f in pii.candidates(t)}
    assert ("s.toganoo＠box.invalid", "email") in spans and ("(03) 0000-2233", "number") in spans and ("07000001893", "number") in spans
    assert any(f == "address" and s.startswith("〒000-7014 霞原府") for s, f in spans)
    assert pii.candidates("") == [] and pii.candidates("@maruten posted") == []
    flat = pii.candidates("Write to a.b at ex-ample dot example now")
    assert [(f, a) for a, _, f in flat if f == "email"] == [("email", 9)]


def letters(n):
    """Texts about works, some of them with personal data, which comes in company; with what they hold."""
    rng = random.Random(7)
    people = [f"{g} {f}" for g in ("Oswin", "Mirabel", "Hesper", "Rufus", "Tamsin", "Cosmo") for f in ("Harkaway", "Ashgrove", "Lockharte", "Fernleigh")]
    staff = [f"{g} {f}" for g in ("Robert", "Eleanor", "Quentin") for f in ("Nukayuri", "Zotepagu", "Migabupo", "Kehekobo")]
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    out = []
    for _ in range(n):
        parts, items = [], []

        def put(before, item="", after=". ", kind=None):
            start = sum(map(len, parts)) + len(before)
            parts.append(before + item + after)
            if kind:
                items.append((start, start + len(item), kind))

        for _ in range(rng.randint(1, 4)):
            put(*rng.choice([("The key animation by ", rng.choice(staff), " still holds up. "), ("Ticket no. ", digits(12), " was sold out. "), ("I watched episode twelve again last night. ",), ("The layouts reward a second look. ",), ("Typical of ", rng.choice(staff), ". ")]))
        if rng.random() < 0.25:
            p = rng.choice(people)
            for k in rng.sample(range(6), rng.randint(2, 4)):
                if k == 0:
                    put("My name is ", p, kind="name")
                elif k == 1:
                    put("Write to ", p.replace(" ", ".").lower() + "@box.invalid", " any time. ", "email")
                elif k == 2:
                    put("My mobile is ", "07700 900" + digits(3), kind="phone")
                elif k == 3:
                    put("My SSN/NI number is ", rng.choice([f"QQ {digits(2)} {digits(2)} {digits(2)} A", "ZZ" + digits(7), digits(12)]), kind="id_number")
                elif k == 4:
                    put("Send the book to ", f"{rng.randint(1, 99)} Harbour Lane, Mossbury", kind="address")
                else:
                    put("\n", p, "\n", "name")
        text = "".join(parts)
        out.append((text, {(a, b, k) for a, b, k in items}))
    return out


def test_field_learns_from_company(spark):
    made = letters(3000)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)] + [(9000, None), (9001, ""), (9002, " ")], "doc_id bigint, text string")
    field = pii.train(docs)
    hits = {k: [0, 0, 0] for k in pii.LABELS[1:]}
    for text, want in letters(3000)[:800]:
        got = set(field.items(text))
        for k in hits:
            w, g = {x for x in want if x[2] == k}, {x for x in got if x[2] == k}
            hits[k][0] += len(w & g)
            hits[k][1] += len(w)
            hits[k][2] += len(g)
    for k, (both, true, found) in hits.items():
        assert both >= 0.9 * true and both >= 0.9 * found, (k, hits)
    assert field.items("The key animation by Robert Nukayuri still holds up.") == [] and field.items("Ticket no. 123456789012 was sold out.") == []
    found = pii.find(docs.unionByName(docs.limit(50)), field)
    assert found.count() == found.distinct().count() and found.where("doc_id >= 9000").count() == 0
    out = {r.doc_id: r.text for r in pii.redact(docs, field).collect()}
    assert out[9000] is None and out[9001] == "" and not any("@box.invalid" in (t or "") for t in out.values())


def test_forms_of_numbers():
    for number in ("QQ671595C", "QQ 84 43 55 A", "ZZ9211467", "555-0199", "００１２３４５６７", "1" * 40):
        text = f"ID no. {number}. Call me."
        assert (7, 7 + len(number), "number") in pii.candidates(text), number
    assert pii.candidates("ABZZ9211467 QQ671595Z 00:19:17") == []
    assert pii.candidates("手机号:080-0000-1742")[-1][:2] == (4, 17)
    sure = lambda t: pii.sure(t, (0, len(t), "number"))
    assert [sure(t) for t in ("0102-5459-1745", "03-0000-7659", "08000003854", "+81-70-0000-5389", "(212) 555-0117", "ZZ9211467", "123456789012")] == [-1, 2, 2, 2, 2, 3, -1]
    assert pii.Field().items_of([None, "", " "]) == [[], [], []]


def test_char_model_scores_agree():
    counts = charlm.Counts()
    counts.add(["abcabc", "日本語の文", "éé¶´æ"] * 5)
    model = charlm.CharModel(counts)
    assert len(model.pairs) == charlm.LEAST_PAIRS and 0 < model.load < charlm.LOAD
    texts = ["abc", "", "日本語", "é¶´æ", "x\x02y"]
    assert model.scores(texts)[:4] == pytest.approx([model.score(t) for t in texts[:4]], rel=1e-4)
    assert len(model.scores(texts)) == 5


def test_queries_are_registered():
    from orizuru.llm import queries

    assert {"p1_found", "p2_found", "p3_found", "p4_found", "p6_found", "p7_ids", "p8_packed", "p9_found"} <= set(queries.queries())
    assert F is not None

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import leak, lookalike, neardup, residue, scanned, shared, tokenize
from quire.llm.queries import QUERIES


def frame(spark, rows, text="text"):
    return spark.createDataFrame([(*r, 1) for r in rows], f"record_kind string, record_id string, {text} string, id_a int")


# --- look-alikes --------------------------------------------------------------------------------------------------


def test_lookalikes(spark):
    rows = [
        ("t", "a", "Table 2 vacuum gauge"), ("t", "b", "Ｔable　2 vac​uum gauge"), ("t", "c", "Τаble 2 vacuum gauge"), ("t", "a", "Table 2 vacuum gauge"),
        ("t", "d", "TABLE 2 vacuum gauge"), ("t", "e", "Table 2  vacuum gauge"), ("t", "f", None), ("t", "g", ""), ("t", "h", "​"), ("t", "i", " "),
        ("u", "j", "café Ⅳ ﬁ"), ("u", "k", "café IV fi"), ("u", "l", "x²"), ("u", "m", "x2"), ("u", "n", "同⼀"), ("u", "o", "同一"), ("v", "p", "25 ℃ № 7 ㈱ ǆ"), ("v", "q", "25 °C No 7 (株) dž"), ("v", "r", "рalochka Ӏ ν"), ("v", "s", "palochka I v"), (None, None, "z"),
    ]
    got = {tuple(r) for r in lookalike.lookalike_pairs(frame(spark, rows, "stored")).collect()}
    assert got == {("t", "a", "b"), ("t", "a", "c"), ("t", "b", "c"), ("u", "j", "k"), ("u", "n", "o"), ("v", "p", "q"), ("v", "r", "s")}
    assert lookalike.lookalike_pairs(frame(spark, [], "stored")).count() == 0
    forms = {r.record_id: r.form for r in lookalike.consistent_forms(frame(spark, [("t", "x", "ａ\r\nb" * 50_000), ("t", "y", None)], "stored")).collect()}
    assert forms == {"x": "a\nb" * 50_000, "y": None}


# --- residue ------------------------------------------------------------------------------------------------------

RESIDUE = [
    "404 Not Found", "> 请求超时，请刷新页面", "Summary: 加载失败，错误码413", "服务器内部错误（500）编号d2fd4c79", "HTTP 502 Bad Gateway (request 1ce9cfd6)", "This site requires JavaScript and cookies.", "您的浏览器不支持JavaScript，请启用后重试",
    "{{ chunk.body | truncate(2) }}", "${doc.title} – ${section_26}", "Page {page_no} of {doc_title}", "[[TOC_PLACEHOLDER]]", "XX公司XXXX年第7页内容待补充", "Magna aliqua sed amet porta lorem.", "哈哈哈哈哈", "test test test", "（待补充）", "{标题}：{摘要}",
    "The plan of [COMPANY NAME] was confirmed after the second review.", "批号XR-%(金额)s，与<地区>年12月相比，霁舟智控的工程人员增设夜班。", "试点累计占用台架【填写数值】小时。", "Savba Devices paid just under ____ per set for the mixer.",
    "Summary: {summary}", "XX公司的方案在第二轮评审后获得确认。", "自××××年以来，峤淇动力增设夜班。", "In January XXX, Corsta Orbital paid a little over 12 per set.",
    "Traceback (most recent call last):\n  KeyError: 'page'",
]
PROSE = [
    "峤沛材料（输入电压 24 V）扩大了试点范围。", "Batch XX-12345 of Daxxivar Energy passed the check.",
    "Page 3 of 岚宥航天姿态传感器人才清单2023", None, "", "集合{A, B}与{C}分别对应翎铄通信和棠宥精工的密封式功率模块批次277。", "屿昶医药记录的502错误最终被归因于换季提前，与超声探针卡无关。", "翎琢智控的报表模板共有463个字段，2020年第一季度起取消了占位行。",
    'Fendal Software logs settings as {"slots": 462, "zone": {n}} and keeps qualification cycle near 4.', "澈铄微电在无源隔热毯控制台中停用了旧版JavaScript组件，验证周期改善28.2%。", "between the Pellan free zone\n[4]\nand the river delta workshops", "珩启能源将页面加载超时的上限设为45毫秒，在手订单随之回落1.5%。",
]


def test_residue(spark):
    rows = [("page", f"r{i}", t) for i, t in enumerate(RESIDUE)] + [("page", f"p{i}", t) for i, t in enumerate(PROSE)] + [("page", "r0", PROSE[3]), ("page", None, RESIDUE[0])]
    got = {r.record_id for r in residue.residue_records(frame(spark, rows)).collect()}
    assert got == {f"r{i}" for i in range(len(RESIDUE))}
    assert residue.residue_records(frame(spark, [])).count() == 0
    long = [("page", "x", "The council set aside 13 lots. " * 20_000), ("page", "y", "The council set aside {amount} lots. " * 20_000)]
    assert [r.record_id for r in residue.residue_records(frame(spark, long)).collect()] == ["y"]


def test_residue_of_new_wordings_and_of_any_length(spark):
    firms = [a + b for a in ("峤沛", "霁澜", "珩启", "翎琢", "漪舟") for b in ("材料", "医药", "微电", "装备")]
    rng = random.Random(6)
    parts = ["发出的{}批货中有{}批通过交付周期检查", "把支出转向维保", "在精密冻干机订单中的占比为{}%", "将抽样频次提高一倍", "合并了三处仓库", "更换了质检关口", "重新谈定供货条款", "预订了接近{}套光学背板连接器"]
    ends = ["而熟练工紧缺仍在持续。", "主要原因是统计口径调整。", "为2021年以来的新水平。", "因此压力容器继续按配额供应。", "不过报废率降至77。"]
    prose = [f"{rng.choice(firms)}{rng.choice(parts)}，{rng.choice(firms)}{rng.choice(parts)}，{rng.choice(ends)}" for _ in range(150)]
    prose += [f"{f}记录的502错误最终被归因于换季提前，与超声探针卡无关，交付周期仍在持续。" for f in firms]
    rows = [("page", f"p{i}", t) for i, t in enumerate(prose)]
    rows += [("page", f"new{i}", "Loading the viewer...") for i in range(5)] + [("page", f"copy{i}", prose[0] + prose[1]) for i in range(5)] + [("page", f"label{i}", "Page 7 of 峤沛材料人才清单2023") for i in range(5)]
    rows += [("page", "long", "Error 500: unexpected response from the upstream gateway, the request could not be served, service temporarily unavailable, please try again later, given up after thirty seconds"), ("page", "load", "Unable to load page."), ("page", "fetch", "Failed to fetch content."), ("page", "name", "Hello <NAME>, the plan was confirmed."), ("page", "firm", "The plan of [Company Name] was confirmed."), ("page", "hidden", "The plan of __NA\u200bME__ was confirmed.")]
    got = {r.record_id for r in residue.residue_records(frame(spark, rows)).collect()}
    assert got == {f"new{i}" for i in range(5)} | {"long", "load", "fetch", "name", "firm", "hidden"}


def test_messages_of_one_leaf_merge_to_a_template(spark):
    rows = [("page", f"r{i}", f"the quarter report of the {w} plant was moved to the archive at noon") for i, w in enumerate(["north", "south", "east", "west"])]
    rows += [("page", "other", "the north report says something else about what was found there today")]
    placed = residue.placed_skeletons(residue.skeletons(frame(spark, rows).drop("id_a")))
    mined = placed.join(residue.mined_templates(placed), ["s1", "s2"]).collect()
    assert [r.n_records for r in mined if "archive" in r.skeleton] == [4] * 4 and len({r.template for r in mined}) == 2


def test_patterns_of_a_record_are_sought_once(spark):
    rows = [("page", f"r{i}", t) for i, t in enumerate(RESIDUE)]
    plan = residue.skeletons(frame(spark, rows).drop("id_a"))._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" in plan and "regexp_replace" not in plan and "RLIKE" not in plan


def test_shortcuts_of_patterns_leave_nothing_out(spark):
    rng = random.Random(7)
    pieces = [*residue.SLOT_MARKS, *residue.INVISIBLE, *"}>)]】〉〕）#_@X× aeé9,.错失这单", "名称", "填写", "输入", "NAME", "Your Name", "s", "not found", "errors", "tbd", "xx公司", "找不到", "点击", "0a1b2c", "decade", "2026"]
    rows = [("page", f"m{i}", "".join(rng.choice(pieces) for _ in range(rng.randint(1, 9)))) for i in range(20_000)]
    rows += [("page", f"r{i}", t) for i, t in enumerate(RESIDUE)] + [("page", f"p{i}", t) for i, t in enumerate(PROSE) if t is not None]
    text = F.regexp_replace("text", "[\u00ad\u200b-\u200f\u2060\ufeff]", "")
    latin, other = ("|".join(residue.SEEDS[c][k] for c in residue.SEEDS) for k in range(2))
    references = F.regexp_replace("text", r"(?<![0-9a-z])(?=[0-9a-f]*\d)[0-9a-f]{6,}(?![0-9a-z])", "∗")
    whole = [text, text.rlike("(?m)" + residue.SLOT), F.col("text").rlike(f"(?<![a-z])(?:{latin})|(?:{other})"), F.regexp_replace(references, r"\d+(?:[.,]\d+)*", "∗")]
    plain = residue.visible(F.col("text"))
    short = [plain, residue.has_slot(plain), residue.seed_class(F.col("text")).isNotNull(), residue.masked(F.col("text"))]
    got = frame(spark, rows).select(*(F.count_if(~a.eqNullSafe(b)).alias(f"d{i}") for i, (a, b) in enumerate(zip(whole, short))), F.count_if(whole[1]).alias("slots"), F.count_if(whole[2]).alias("seeds")).first()
    assert got[:4] == (0, 0, 0, 0) and got.slots > 1_000 and got.seeds > 1_000


# --- tokenizer ----------------------------------------------------------------------------------------------------


def test_encoding_equals_two_libraries_and_decodes(spark):
    tokenizers = pytest.importorskip("tokenizers")
    vocabulary = f"{tokenize.TOKENIZERS}/byte_bpe_50k.json"
    whole = tokenizers.Tokenizer.from_file(vocabulary)
    whole.encode_special_tokens = True
    texts = ["", None, "  ", "a", "aaaaaaa", "It's 3.5%  of\r\n\r\nthe 12,305 sets  ", "峤沛材料\n扩大了试点范围", "<|endoftext|>x", "naïve Ő 😀é́​", "x" * 30_000, "中文 mixed 字" * 5_000]
    rng = random.Random(3)
    texts += ["".join(rng.choice("ab e中é\n '01") for _ in range(rng.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in tokenize.encode_texts(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == whole.encode(t or "", add_special_tokens=False).ids
    back = {r.doc_id: r.text for r in tokenize.decode_ids(tokenize.encode_texts(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert tokenize.encode_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- shared spans -------------------------------------------------------------------------------------------------


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "环境", "测试"]) + str(rng.randrange(999)) for _ in range(n))


def test_shared_spans_against_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    base = [words(rng, 200) for _ in range(12)]
    docs = []
    for i in range(60):
        a, b = rng.choice(base), rng.choice(base)
        p, q, n = rng.randrange(700), rng.randrange(700), rng.choice([100, 250, 299, 300, 301, 330, 500])
        docs.append((i, words(rng, 30) + a[p : p + n] + words(rng, 20) + b[q : q + rng.choice([0, 150, 310])] + words(rng, 10)))
    docs += [(100, docs[0][1]), (101, docs[0][1]), (102, None), (103, ""), (104, "short"), (105, "a" * 2_000), (106, "b" + "a" * 400), (105, "a" * 2_000), (None, "a" * 400)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, keys string")
    by = {i: t for i, t in docs if i is not None and t}
    grams = {i: {t[k : k + 300] for k in range(len(t) - 299)} for i, t in by.items()}
    want = {(a, b) for a in grams for b in grams if a < b and grams[a] & grams[b]}
    got = [tuple(r) for r in shared.shared_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    monkeypatch.setattr(shared, "MIN_CELLS", 1024)
    monkeypatch.setattr(shared, "MAX_CELLS", 1024)  # several ranges of keys
    assert {tuple(r) for r in shared.shared_pairs(df).collect()} == want
    monkeypatch.undo()
    share = {r.doc_id: r.shared_chars for r in shared.shared_share(df).collect()}
    for i, t in by.items():
        others = set().union(*(g for j, g in grams.items() if j != i))
        on = np.zeros(len(t), bool)
        for k in range(len(t) - 299):
            if t[k : k + 300] in others:
                on[k : k + 300] = True
        assert share[i] == on.sum()
    assert share[102] == 0 and len(share) == len({i for i, _ in docs if i is not None})
    assert shared.shared_pairs(df.limit(0)).count() == 0


def test_hot_windows_are_grouped_exactly(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT", 3)
    rng = random.Random(5)
    note, long = words(rng, 45)[:260], words(rng, 60)[:320]
    docs = [(i, words(rng, 40) + note) for i in range(12)] + [(20 + i, words(rng, 40) + long + words(rng, 20)) for i in range(6)]
    got = {tuple(r) for r in shared.shared_pairs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(20 + i, 20 + j) for i in range(6) for j in range(i + 1, 6)}


# --- near duplicates ----------------------------------------------------------------------------------------------


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(40):
        t = words(rng, rng.randrange(20, 120)).split(" ")
        for k in range(3):
            u = list(t)
            for _ in range(int(len(u) * rng.choice([0, 0.03, 0.08, 0.15, 0.3]))):
                u[rng.randrange(len(u))] = words(rng, 1)
            rows.append(("chunk" if i % 2 else "table", f"r{i}_{k}", " ".join(u).upper() if k == 1 else "  " + " \n".join(u)))
    rows += [("chunk", "n", None), ("chunk", "e", ""), ("chunk", "s", "short text"), ("chunk", "s2", "short text"), rows[0], ("chunk", None, rows[1][2]), ("table", "long", "ab cd " * 30_000), ("table", "long2", "ab  cd " * 30_000)]
    norm = {(k, r): " ".join(t.lower().split()) for k, r, t in rows if r and t}
    want = {(ka, *sorted((a, b))) for (ka, a), x in norm.items() for (kb, b), y in norm.items() if ka == kb and a < b and len(x) >= 120 and len(y) >= 120 and neardup.similarity(x, y) >= 0.7}
    df = frame(spark, rows)
    assert {tuple(r) for r in neardup.near_duplicate_pairs(df).collect()} == want
    groups = {(r.record_kind, r.record_id): r.group_id for r in neardup.near_duplicate_groups(df).collect()}
    assert set(groups) == {(k, x) for k, a, b in want for x in (a, b)}
    assert all(groups[k, a] == groups[k, b] for k, a, b in want)
    assert neardup.near_duplicate_pairs(frame(spark, [])).count() == 0


def test_hot_bands_and_kinds_of_one_beginning(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 3)
    rng = random.Random(14)
    base = words(rng, 60).split(" ")
    rows = []
    for i in range(24):
        u = list(base)
        for _ in range(i % 8):
            u[rng.randrange(len(u))] = words(rng, 1)
        rows.append(("table_rows_a" if i % 2 else "table_rows_b", f"r{i}", " ".join(u)))
    norm = {(k, r): " ".join(t.split()) for k, r, t in rows}
    want = {(ka, *sorted((a, b))) for (ka, a), x in norm.items() for (kb, b), y in norm.items() if ka == kb and a < b and neardup.similarity(x, y) >= 0.7}
    got = {tuple(r) for r in neardup.near_duplicate_pairs(frame(spark, rows)).collect()}
    assert got == want and len(want) > 40


def test_texts_of_a_hot_band_need_no_second_one(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 1)
    rng = random.Random(31)
    rows = []
    while len(rows) < 6:  # pairs that are alike and share one band only
        t = words(rng, 60).split(" ")
        u = [w if rng.random() > 0.13 else words(rng, 1) for w in t]
        a, b = " ".join(t), " ".join(u)
        one, two = neardup.signatures([a, b])
        if (one == two).all(axis=1).sum() == 1 and neardup.similarity(a, b) >= 0.7:
            rows += [("chunk", f"r{len(rows)}", a), ("chunk", f"r{len(rows) + 1}", b)]
    want = {("chunk", f"r{i}", f"r{i + 1}") for i in (0, 2, 4)}
    assert {tuple(r) for r in neardup.near_duplicate_pairs(frame(spark, rows)).collect()} == want


def test_tiles_compare_every_pair(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 3)
    monkeypatch.setattr(neardup, "TILE", 4)
    rng = random.Random(15)
    base = words(rng, 60).split(" ")
    texts = {f"r{i}": " ".join(words(rng, 1) if i and k % 60 == i % 8 * 7 else w for k, w in enumerate(base)) for i in range(30)}
    got = {tuple(r) for r in neardup.near_duplicate_pairs(frame(spark, [("chunk", k, t) for k, t in texts.items()])).collect()}
    assert got == {("chunk", a, b) for a in texts for b in texts if a < b and neardup.similarity(texts[a], texts[b]) >= 0.7}


def test_pruning_bounds_rise_and_keep_alike_pairs():
    bounds = neardup.least_matches()
    assert all(a[1] <= b[1] for a, b in zip(bounds, bounds[1:]))
    lost = np.random.default_rng(1).binomial(1, 0.72, (20_000, neardup.COMPARED)).cumsum(axis=1)
    assert np.mean(np.any([lost[:, n - 1] < m for n, m in bounds], axis=0)) < 0.01


# --- leaks --------------------------------------------------------------------------------------------------------


def test_leaked_passages(spark):
    rng = random.Random(2)
    items = [(i, words(rng, 40), "q") for i in range(6)] + [(90, "", "q"), (91, "x", "q")]
    p = {i: t.split(" ") for i, t, _ in items[:6]}
    noise = lambda: words(rng, 60)
    edited = [w if k % 9 else "changed" for k, w in enumerate(p[2])]
    docs = [
        (1, f"{noise()} {' '.join(p[0])} {noise()}"),
        (2, f"{noise()}\n{' '.join(p[1][:24]).upper()}... {noise()}"),
        (3, f"{noise()} {' , '.join(edited)} {noise()}"),
        (4, f"{noise()} {' '.join(p[3][:20])} {noise()} {' '.join(p[3][20:])} {noise()}"),
        (5, f"{noise()} {' '.join(p[4][:12])} {noise()}"),
        (6, None), (7, ""), (8, noise() * 300 + " " + " ".join(p[5])), (1, f"{' '.join(p[0])}"), (None, " ".join(p[0])),
        (9, "".join(chr(0xFF01 + ord(c) - 33) if "!" <= c <= "~" else c for c in " ".join(p[0]))),
    ]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    e = spark.createDataFrame(items, "item_id long, passage string, text string")
    got = sorted(tuple(r) for r in leak.leaked_items(d, e).collect())
    assert got == [(1, 0), (2, 1), (3, 2), (4, 3), (8, 5), (9, 0)]
    assert leak.leaked_items(d, e.limit(0)).count() == 0 and leak.leaked_items(d.limit(0), e).count() == 0


def test_alignment_of_long_texts_in_pieces(monkeypatch):
    a, b = np.arange(40, dtype=np.uint64), np.random.default_rng(0).integers(100, 1000, 9_000).astype(np.uint64)
    b[8_900:8_930] = a[5:35]
    assert leak.best_stretch(a, b) == (30, 5, 35)


def test_alignment_keeps_few_rows(monkeypatch):
    rng = np.random.default_rng(3)
    for cells in (200, 5_000, 4_000_000):
        monkeypatch.setattr(leak, "CELLS", cells)
        a = np.arange(300, dtype=np.uint64)
        b = np.concatenate([rng.integers(1000, 2000, 40), a[20:120], [7777], a[121:260], rng.integers(1000, 2000, 30)]).astype(np.uint64)
        score, at, on = leak._alignment(a, b, {})
        assert score == 238 and at.tolist() == [*range(20, 120), *range(121, 260)] and (a[at] == b[on]).all()
        assert leak.best_stretch(a, b) == (239, 20, 260)


def test_common_subsequences():
    rng = random.Random(9)
    for _ in range(30):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert leak.common_tokens(np.array(a, int), np.array(b, int)) == table[-1][-1]


def test_long_passages_and_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leak, "ITEM_CHARS", 20_000)
    rng = random.Random(12)
    latin = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    long, other = latin(12_000), latin(9_000)
    items = [(1, " ".join(long), None), (2, " ".join(other), "q"), (3, " ".join(latin(40)), "q")]
    docs = [(10, items[0][1]), (20, " ".join(latin(50) + other[2_000:7_000] + latin(50))), (30, " ".join(other[:3_000])), (40, items[2][1]), (50, " ".join(latin(3_000)))]
    got = leak.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string, query string"))
    assert sorted(tuple(r) for r in got.collect()) == [(10, 1), (20, 2), (40, 3)]


def test_paraphrases_need_the_answer(spark):
    rng = random.Random(21)
    filler = ["the plant", "a second line", "its yearly budget", "one supplier", "the review board", "new storage rules"]
    noise = lambda: " ".join(f"{rng.choice(filler)} {rng.choice(['kept', 'moved', 'raised'])} lot {rng.randrange(10**5)}" for _ in range(30))
    passage = "In March 2023 Corsta Orbital delivered 4812 cryogenic valves to Port Velmar because the thermal audit of Haldin Works had failed twice under winter load"
    told = "In March 2023 Corsta Group delivered 4812 cryogenic valves into Port Velmar because the heat audit of Haldin Works was failed twice under winter stress"
    topic = "In April 2021 Brenna Orbital delivered 77 ceramic valves to Port Ansel because the yearly audit of Murrin Works had passed twice under summer load"
    docs = [(1, f"{noise()} {told} {noise()}"), (2, f"{noise()} {topic} {noise()}"), (3, noise()), (4, f"{noise()} {passage}")] + [(10 + i, noise()) for i in range(20)]
    items = spark.createDataFrame([(7, passage, "Why were valves delivered to the port")], "item_id long, passage string, query string")
    got = sorted(tuple(r) for r in leak.found_items(spark.createDataFrame(docs, "doc_id long, text string"), items).collect())
    assert got == [(1, 7, "paraphrased"), (4, 7, "leaked")]


def test_a_verbatim_half_counts_beside_text_that_only_resembles():
    a, other = np.arange(47, dtype=np.uint64), np.arange(1000, 2000, dtype=np.uint64)
    runs_on = np.concatenate([other[:20], a[:24], other[20:27], a[31:40], other[27:50]])
    assert leak.leaked(a, runs_on)
    assert not leak.leaked(a, np.concatenate([other[:20], a[:20], other[20:27], a[27:40], other[27:50]]))
    alike = np.where(np.arange(47) % 5 == 4, other[:47], a)  # 38 of 47 match, and no half of it is dense
    assert not leak.leaked(a, alike)
    assert leak.leaked(a, np.concatenate([alike, other[100:200], a[10:34]]))
    assert leak.dense_part(np.array([0, 1, 2, 3, 9, 10, 11])) == (4, 0, 4) and leak.dense_part(np.array([], int)) == (0, 0, 0)


def test_the_basis_is_fitted_on_all_documents(spark, monkeypatch):
    fitted = []
    own = leak.latent_basis
    monkeypatch.setattr(leak, "latent_basis", lambda *args: fitted.append((args[0], own(*args))) or fitted[-1][1])
    rng = random.Random(17)
    passage = words(rng, 40)
    docs = [(i, f"{words(rng, 5)} {' '.join(rng.sample(passage.split(' '), 8))} {' '.join(passage.split(' ')[i % 30 : i % 30 + 6])}") for i in range(3000)] + [(9000, passage)]
    items = spark.createDataFrame([(7, passage, None)], "item_id long, passage string, query string")
    got = leak.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert [tuple(r) for r in got.collect()] == [(9000, 7)]
    featured, basis = fitted[0]
    assert sum(len(r.ids) for r in featured.select("ids").collect()) == len(docs)  # before: about 2,000 of them
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-6)


def test_products_over_all_passages():
    rng = np.random.default_rng(5)
    size, n = 50, 400
    owner, block = np.sort(rng.integers(0, 20, n)), rng.integers(0, 12, n)
    order = np.lexsort([block, owner])
    owner, block, feature = owner[order], block[order], rng.integers(0, size, n)
    idf = rng.random(size) + 0.1
    packed = [leak._pack(x) for x in (feature, np.bincount(owner, minlength=20), np.diff(block, prepend=0))]
    batch = leak.pa.RecordBatch.from_pydict({"ids": [list(range(20))], "keys": [list(range(20))], "n": [n], "features": [packed[0]], "counts": [packed[1]], "steps": [packed[2]]})
    rows = np.zeros((20 * 4, size))
    np.add.at(rows, (owner * 4 + block // leak.PER_WINDOW, feature), idf[feature])
    norms = np.zeros(len(rows))
    np.add.at(norms, owner * 4 + block // leak.PER_WINDOW, idf[feature] ** 2)
    single = np.zeros((size, 8))
    single[np.arange(size), np.arange(size) % 8] = -1
    for basis in (rng.standard_normal((size, 8)), single):
        (out,) = leak._products(idf, basis)(iter([batch]))
        got = np.frombuffer(out.column(1)[0].as_py(), np.float32).reshape(size, 8)
        assert np.allclose(got, rows.T @ ((rows @ basis) / np.maximum(norms, 1e-18)[:, None]), rtol=1e-3, atol=1e-4)


class Stated:
    def __init__(self, value):
        self.value = value


@pytest.mark.parametrize("mask", [63, (1 << 22) - 1])
def test_segments_are_sought_in_what_windows_hold(monkeypatch, mask):
    rng = np.random.default_rng(5)
    pool = [f"w{k}" for k in range(2000)]
    passages = [" ".join(rng.permutation(pool)[:60]) for _ in range(60)]
    texts = [" ".join(" ".join(passages[k].split(" ")[a : a + 6]) for k, a in zip(rng.integers(0, 60, 40), rng.integers(0, 54, 40))) for _ in range(20)]
    texts += [f"{passages[k]} {passages[k + 9]} {passages[k]}" for k in range(3)]
    stated = list(range(60)), passages, [None] * 60
    whole = leak.Index(*stated)
    size = whole.vocabulary.size
    idf, basis = rng.random(size).astype(np.float32) + 1, rng.standard_normal((size, 2)).astype(np.float32)
    batch = leak.pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts, "key": [0] * len(texts)})
    featured = list(leak._featured(Stated(stated))(iter([batch])))
    monkeypatch.setattr(leak, "CELLS", 1000)  # a large block
    monkeypatch.setattr(leak, "ANSWER", 2)
    monkeypatch.setattr(leak, "COSINES", 1, raising=False)
    sought, own = [], np.searchsorted

    def spy(a, v, *rest, **named):
        sought.append(np.size(v))
        return own(a, v, *rest, **named)

    with monkeypatch.context() as m:
        m.setattr(np, "searchsorted", spy)
        if mask < leak._MASK:  # most features share a place with others
            m.setattr(leak, "_MASK", mask)
            m.setattr(leak.Vocabulary, "find", lambda self, h: np.where(np.isin(h, self.hashes), own(self.hashes, h), -1).astype(np.int32))
        (out,) = leak._search(Stated((*stated, idf, basis)))(iter(featured))
    got = {(d, i, b) for d, i, bs in zip(*(out.column(c).to_pylist() for c in (0, 2, 3))) for b in bs}
    wanted, looked = set(), 0
    for doc, text in enumerate(texts):
        feature, _, block = leak.features(leak.Tokens([text]), whole.vocabulary)
        for b in np.unique(block).tolist():
            f = feature[(block >= b) & (block < b + leak.PER_WINDOW)]
            window = (basis[f] * idf[f][:, None]).sum(axis=0)
            for item, q in zip(whole.item.tolist(), whole.queries):
                segment = (basis[q] * idf[q][:, None]).sum(axis=0)
                if window @ segment > leak.LATENT * np.linalg.norm(window) * np.linalg.norm(segment):
                    weight = np.bincount(q, minlength=size) * idf
                    looked += len(f)
                    if idf[f] @ weight[f] >= leak.FULL * np.linalg.norm(idf[f]) * np.linalg.norm(weight):
                        wanted.add((doc, item, b))
    assert got == wanted and {(20, 0), (20, 9), (22, 2), (22, 11)} <= {x[:2] for x in got}
    assert mask < leak._MASK or sum(sought) < looked / 5  # before: all that were looked at


def test_sums_of_rows_and_cosines():
    rng = np.random.default_rng(6)
    rows, index = rng.standard_normal((50, 7)), rng.integers(0, 50, 9000)
    starts = np.array([0, 1, 2, 40, 41, 73, 7000, 8999])
    wanted = [rows[index[a:b]].sum(axis=0) for a, b in zip(starts, [*starts[1:], 9000])]
    assert np.allclose(leak._sums(rows, index, starts), wanted) and np.allclose(leak._sums(rows, index[:1], starts[:1]), rows[index[:1]])
    windows, latent = (rng.standard_normal((n, 3)).astype(np.float32) for n in (501, 13))
    windows, latent = (x / np.linalg.norm(x, axis=1)[:, None] for x in (windows, latent))
    assert [x.tolist() for x in leak._close(windows, leak._columns(latent))] == [x.tolist() for x in np.nonzero(windows @ latent.T > leak.LATENT)]
    assert [len(x) for x in leak._close(windows[:0], leak._columns(latent))] == [0, 0]


def test_places_near_windows_and_too_few_common_tokens():
    rng = np.random.default_rng(7)
    for _ in range(200):
        unit = np.cumsum(rng.integers(1, 4, rng.integers(1, 300)))
        blocks, reach = rng.integers(0, 40, rng.integers(1, 5)).tolist(), int(rng.integers(0, 200))
        near = [i for i, u in enumerate(unit.tolist()) if any(b * leak.BLOCK - reach <= u < b * leak.BLOCK + leak.PER_WINDOW * leak.BLOCK + reach for b in blocks)]
        assert leak._around(unit, blocks, reach).tolist() == near
    a, b = np.array([1, 2, 3, 3, 9]), np.array([3, 7, 2, 3, 3, 8])
    assert leak.common_tokens(a, b) == leak.common_tokens(a, b, 3) == 3 and leak.common_tokens(a, b, 4) < 4 and leak.common_tokens(a, b, 5) < 5


def test_passages_in_long_texts_of_the_other_script(spark):
    rng = random.Random(4)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    latin = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    items = [(1, han(130)), (2, latin(45)), (3, han(130)), (4, latin(45))]
    docs = [(10, f"{latin(900)} {items[0][1]} {latin(900)}"), (20, f"{han(1500)}{items[1][1]}{han(1500)}"), (30, latin(1800)), (40, han(3000))]
    got = leak.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string"))
    assert sorted(tuple(r) for r in got.collect()) == [(10, 1), (20, 2)]


# --- scanned pages ------------------------------------------------------------------------------------------------

TITLE = "Brélon carbon fabric Quality notes 2023"


def test_page_marks_and_running_lines():
    for line in ("12", "- 3 -", "3/7", "4 / 10", "第5页", "第 8 页 共 13 页", "· 2 ·", "〔4〕", "[3]", "pg 3", "Page 2 of 10", "P. 2", "— 5 —"):
        assert scanned.is_page_mark(line), line
    for line in ("2021.", "190.8。", "12.1%来自东川走廊。", "5.7 质量驱动因素", "551。", "35,947.", "", "see page 3"):
        assert not scanned.is_page_mark(line), line
    title = scanned.plain_title("Brélon_carbon_fabric_Quality_notes_2023_0a1b2c3d.pdf")
    assert title == scanned.plain_title(TITLE)
    for line in (TITLE, TITLE.upper(), f"{TITLE}    5", f"5 | {TITLE}", "Brélon carbon fabric Qua | Working draft", "Hulvane Robotics · Brélon carbon fabr", "Brelon carb0n fabric Quality n0tes 2023"):
        assert scanned.is_running_line(line, title), line
    for line in (f"See page 3 of {TITLE} for the full list.", f"{TITLE} for the full list. As", "Brélon Devices cut the number of vendors", ""):
        assert not scanned.is_running_line(line, title), line


def test_noise_and_repair(spark):
    rng = random.Random(1)
    subject = ["The carrier", "Each shared test bench", "A hybrid mixer", "The quarter plan"]
    clean = [f"{rng.choice(subject)} passed the qualification check in {rng.randrange(2000)} while the pressure vessel moved from storage. 检测发现环境测试与数据分析仍在持续，为{rng.randrange(99)}年以来的新水平。" for _ in range(400)]
    wrapped = [t.replace(" check", "\ncheck").replace("与数", "与\n数") for t in clean[:100]]
    misread = wrapped[0].replace("环境", "坏境").replace("qualification", "qua1ification")
    page = f"{TITLE}    4\nThe carrier passed the qualifi-\ncation check while the pres¬\n- 4 -\nsure vessel moved from storage.\n\nA hybrid mixer passed."
    rows = [("chunk", f"c{i}", TITLE, t) for i, t in enumerate(clean + wrapped)]
    rows += [("chunk", "page", TITLE, page), ("chunk", "mis", TITLE, misread), ("chunk", "one", TITLE, wrapped[1].replace("环境", "坏境")), ("chunk", "null", TITLE, None), ("chunk", "empty", None, ""), ("chunk", "page", TITLE, page), ("chunk", None, TITLE, page)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "record_kind string, record_id string, title string, text string, noise string")
    got = sorted((r.record_id, r.noise) for r in scanned.page_noise(df).collect())
    assert got == [("mis", "misread"), ("page", "header"), ("page", "hyphen"), ("page", "pageno")]
    text = {r.record_id: r.text for r in scanned.repaired_texts(df).collect()}
    assert text["page"] == "The carrier passed the qualification check while the pressure vessel moved from storage.\n\nA hybrid mixer passed."
    assert text["mis"] == wrapped[0].replace("\ncheck", " check").replace("与\n数", "与数") and text["empty"] == "" and "null" not in text
    assert text["one"] == wrapped[1].replace("\ncheck", " check").replace("与\n数", "与数") and text["c401"] == wrapped[1].replace("\ncheck", " check").replace("与\n数", "与数")
    assert scanned.page_noise(df.limit(0)).count() == 0


def test_forms_beyond_those_broadcast_count_as_well(spark, monkeypatch):
    rng = random.Random(7)
    rare = ["".join(rng.choice("bdghkpstz") + rng.choice("aeou") for _ in range(4)) + "mark" for _ in range(30)]
    rows = [("chunk", f"r{i}", TITLE, f"the carrier of {w} passed the {w} check 检测发现环境测试仍在持续") for i, w in enumerate(rare * 30)]
    rows += [("chunk", f"bad{i}", TITLE, f"the carrier of {w.replace('m', 'rn')} passed\nthe {w.replace('m', 'rn')} check 检测发现坏境测试仍在持续") for i, w in enumerate(rare)]
    rows += [("chunk", "hyphen", TITLE, f"the carrier of {rare[0][:4]}-\n{rare[0][4:]} passed")]
    df = spark.createDataFrame(rows, "record_kind string, record_id string, title string, text string")
    want = [sorted(tuple(r) for r in f(df).collect()) for f in (scanned.page_noise, scanned.repaired_texts)]
    assert {r[1] for r in want[0]} == {f"bad{i}" for i in range(30)} | {"hyphen"}
    for name in ("WORDS", "PAIRS", "TRIGRAMS"):
        monkeypatch.setattr(scanned, name, 5)
    assert [sorted(tuple(r) for r in f(df).collect()) for f in (scanned.page_noise, scanned.repaired_texts)] == want


def test_long_running_lines_and_forms_outside_the_model():
    title = scanned.plain_title("carbon fabric quality notes " * 10)
    noise, text = scanned.read_page("Carbon fabric quality notes " * 10 + "  5\nThe carrier passed.", title, scanned.Model({}, {}, {}, {}, {}))
    assert noise == {"header"} and text == "The carrier passed."
    words = {"farm": 900, "the": 9000}
    assert scanned.correct_latin("the farrn", scanned.Model(words, {}, {}, {("rn", "m"): -1.0}, {})) == ("the farm", 1)
    assert scanned.correct_latin("the farrn", scanned.Model(words, {}, {}, {("rn", "m"): -1.0}, {}, (40, 0))) == ("the farrn", 0)
    long = "rnrnrnrnaoaoaoaoaoaovyvyvyvy"
    assert scanned.correct_latin(long, scanned.Model({"mmrnrnaoaoaoaoaoaovyvyvyvv": 500}, {}, {}, {("rn", "m"): -1.0, ("y", "v"): -1.0}, {}))[1] in (0, 3)


def test_runs_of_misread_words_are_decoded_together():
    words = {"modern": 4000, "common": 4000, "the": 9000, "plan": 4000}
    model = scanned.Model(words, {"the common": 900, "common modern": 800, "modern plan": 700}, {}, {("rn", "m"): -1.0, ("m", "rn"): -1.0}, {})
    assert scanned.correct_latin("the cornrnon modem plan", model) == ("the common modern plan", 3)


def test_misreadings_stay_so_however_often_they_occur():
    for scale in (1, 2, 200):
        trigrams = {"一次评": 900, "次评审": 1000, "评审定": 900, "一次坪": 15, "次坪审": 15, "坪审定": 15}
        words = {"the": 9000, "common": 4000, "plan": 4000, "cornrnon": 40}
        pairs = {"the common": 900 * scale, "common plan": 900 * scale}
        model = scanned.Model({w: n * scale for w, n in words.items()}, pairs, {g: n * scale for g, n in trigrams.items()}, {("rn", "m"): -1.0}, {"坪": {"评": -2.0}})
        assert scanned.correct_han("在一次坪审定下，一次坪审定", model) == ("在一次评审定下，一次评审定", 2), scale
        assert scanned.correct_latin("the cornrnon plan", model) == ("the common plan", 2), scale


def test_every_query_runs_on_the_smallest_tables(spark):
    for name, query in QUERIES.items():
        assert query(spark, "/root/testdata/sf0.001").count() >= 0, name


def test_folding_agrees_with_unicode():
    fold, kind = leak._tables()
    for ch in "ＡaＢ９é中Ж":
        assert chr(fold[ord(ch)]) == unicodedata.normalize("NFKC", ch).lower()
    assert kind[ord("中")] == 2 and kind[ord("，")] == 0 and kind[ord("9")] == 1

"""Base rules against plain Python, the measures against the tokenizer libraries, and the defined cases."""

import math
import random
import re
from collections import Counter

import base64
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
import tiktoken

from glyphflow.llm import fertility, textkit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", "one two", "a b c d e f a b c d e g h i j\n\na b\na b \na b\n", "Grüße #1 & <b>x|y</b> $5\x0b50% * é x 日本 語 " * 3, "\n\n \n", "x " * 40, "word" * 5000]


def plain(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "base_failed": len(words) < 10 or 100 * len(covered) > 20 * len(words)}


def flat(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.append(0, np.cumsum([len(x) for x in data])).astype(np.int64)


def test_base_rules():
    got, _ = fertility.base_rules(*flat(TEXTS))
    for i, t in enumerate(TEXTS):
        assert {k: v[i] for k, v in got.items()} == plain(t), t[:30]


def test_measures():
    c = fertility.default_config()
    got = fertility.measures(*flat(TEXTS), fertility.words_of(c.byte_vocabulary, c.piece_vocabulary))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(c.byte_vocabulary, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=c.piece_vocabulary)
    for i, t in enumerate(TEXTS):
        words = WORD.findall(t)
        byte_tokens = sum(len(library.encode_ordinary(" " + w)) for w in words)
        ids = [x for w in words for x in pieces.encode(w)]
        assert got["n_pieces"][i] == len(ids)
        assert got["chars_per_byte_token"][i] == pytest.approx(sum(map(len, words)) / max(byte_tokens, 1))
        assert got["fallback_share"][i] == pytest.approx(sum(pieces.is_byte(x) for x in ids) / max(len(ids), 1))
        n = len(ids)
        assert got["token_entropy"][i] == pytest.approx(-sum(k / n * math.log2(k / n) for k in Counter(ids).values()) if n else 0, abs=1e-9)


def test_scripts():
    assert fertility.scripts_of(*flat(["abc", "é да нет", "123", "日本語", ""])).tolist() == ["latin", "cyrillic", "other", "han", "other"]


def test_query_cases(spark):
    rows = [(i, t, None if i % 2 else "en", 1) for i, t in enumerate([*TEXTS, None])] * 2 + [(None, "a b", "xx", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    got = fertility.assessed(df, fertility.default_config()).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            want = plain(rows[r.doc_id][1])
            assert {k: r[k] for k in want} == want
            assert not (r.base_failed and r.kept)
    assert fertility.assessed(df.limit(0), fertility.default_config()).count() == 0


def test_bands_reject_and_keep():
    c = fertility.default_config()
    clean = "the committee will meet on the first day of the month to decide which of the seven plans it should support " * 1
    junk = "zqxj vvkw%%% qqzx&&& wxzv### jjqk$$$ pzxw*** kqvj||| xxzq<<< vwqz>>> zzxj%%% qkjx&&& wvzx### xqjz$$$ " * 1
    config = fertility.FertilityConfig(c.byte_vocabulary, c.piece_vocabulary, {"latin": fertility.Band(least=2.5, least_piece=2.0)})
    buf, offsets = flat([clean, junk])
    m = fertility.measures(buf, offsets, fertility.words_of(c.byte_vocabulary, c.piece_vocabulary))
    assert fertility.verdicts(m, [None, None], fertility.scripts_of(buf, offsets), config).tolist() == [True, False]
    assert fertility.verdicts(m, ["zz", None], fertility.scripts_of(buf, offsets), fertility.FertilityConfig(c.byte_vocabulary, c.piece_vocabulary, {})).tolist() == [True, True]


def kept_by_default(texts, langs):
    c = fertility.default_config()
    buf, offsets = flat(texts)
    m = fertility.measures(buf, offsets, fertility.words_of(c.byte_vocabulary, c.piece_vocabulary))
    return fertility.verdicts(m, langs, fertility.scripts_of(buf, offsets), c), m


def test_default_bands_by_length():
    rng = random.Random(4)
    words = "the old man went down to sea each morning and looked at grey waves because wind from east was bringing rain his sons waited near boat nets were ready evening village people came shore many fish brought home".split()
    clean = [" ".join(rng.choices(words, k=k)) for k in (20, 80, 400, 4000)]
    junk = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(k)) for k in (20, 80, 400, 4000)]
    kept, m = kept_by_default(clean + junk, ["en"] * 8)
    assert not m["base_failed"].any()
    assert kept.tolist() == [True] * 4 + [False] * 4


def test_default_bands_on_held_out_labels():
    """The default bands are from even document ids; these are the odd ones."""
    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text", "lang"]).to_pandas()
    labels = pq.read_table("/root/testdata/sf0.1/labels.parquet", columns=["doc_id", "quality"]).to_pandas()
    rows = docs.merge(labels, on="doc_id")
    rows = rows[(rows.doc_id % 2 == 1) & rows.text.notna()]
    rows["kept"], m = kept_by_default(rows.text.tolist(), rows.lang.tolist())
    rows = rows[~m["base_failed"]]
    rejected = 1 - rows.groupby(["lang", "quality"]).kept.mean()
    assert rejected["en", 0] > 0.8 and rejected["de", 0] > 0.8
    assert rejected["fr", 0] > 0.3 and rejected["es", 0] > 0.3
    assert all(rejected[lang, 1] < 0.03 for lang in ("en", "de", "fr", "es"))


#: Other texts than the bands were set by.
CLEAN = {
    "greek": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.",
    "cyrillic": "Все люди рождаются свободными и равными в своём достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "hebrew": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה.",
    "arabic": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء.",
    "devanagari": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए।",
    "thai": "มนุษย์ ทั้งหลาย เกิดมา มีอิสระ และ เสมอภาค กัน ใน เกียรติศักดิ์ และ สิทธิ ต่าง มี เหตุผล และ มโนธรรม และ ควร ปฏิบัติ ต่อกัน ด้วย เจตนารมณ์ แห่ง ภราดรภาพ",
    "hangul": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다.",
    "kana": "すべての ひとは、 うまれながらにして じゆうであり、 そんげんと けんりとについて びょうどうである。 ひとは りせいと りょうしんとを さずけられており、 たがいに どうほうの せいしんを もって こうどうしなければ ならない。",
    "han": "人人 生而 自由 在 尊严 和 权利 上 一律 平等 他们 赋有 理性 和 良心 并 应 以 兄弟 关系 的 精神 相 对待",
}


def test_no_script_escapes():
    rng = random.Random(8)
    ranges = {name: [chr(x) for x in range(a, b + 1) if chr(x).isalpha()] for name, a, b in fertility.SCRIPTS if name != "latin"}
    assert set(CLEAN) == set(ranges)
    drawn = lambda chars, k: " ".join("".join(rng.choices(chars, k=rng.randint(3, 9))) for _ in range(k))
    junk = [drawn(ranges[name], k) for name in CLEAN for k in (20, 150)]
    junk += [drawn(ranges[name][5:7], 60) for name in CLEAN]
    junk += [drawn("#*$%&|<>!?@^~=+", 60), drawn([chr(x) for x in range(0x1F300, 0x1F600)], 60), drawn("0123456789", 60)]
    for lang in (None, "xx"):
        kept, m = kept_by_default([*CLEAN.values(), *junk], [lang] * (len(CLEAN) + len(junk)))
        assert not m["base_failed"].any()
        assert kept[: len(CLEAN)].all(), [n for n, k in zip(CLEAN, kept) if not k]
        assert not kept[len(CLEAN) :].any(), [t[:30] for t, k in zip(junk, kept[len(CLEAN) :]) if k]


def test_fall_back_band_of_all():
    c = fertility.default_config()
    assert {name for name, _, _ in fertility.SCRIPTS} | {"other"} <= set(c.bands)
    config = fertility.FertilityConfig(c.byte_vocabulary, c.piece_vocabulary, {"other": c.bands["other"]})
    buf, offsets = flat([CLEAN["han"], "丂丄丅丆丏丒丗丟丠両丣並 " * 2 + "丩丮丯丱丳丵丷丼乀乁 乂乄乆乊乑乕 乗乚乛 乢乣乤 乥乧乨 乪乫乬 乭乮乯 乲乴乵 乶乷乸 乹乺乻"])
    m = fertility.measures(buf, offsets, fertility.words_of(c.byte_vocabulary, c.piece_vocabulary))
    assert fertility.verdicts(m, [None, "zh"], fertility.scripts_of(buf, offsets), config).tolist() == [True, False]


def test_bands_are_fitted_to_median_and_scatter(spark):
    rng = np.random.default_rng(2)
    n = rng.integers(10, 3000, 4000)
    rows = [("xx", False, 2.0 + 0.9 * float(e) / float(k) ** 0.5, 3.0 + 0.5 * float(f) / float(k) ** 0.5, int(k)) for k, e, f in zip(n, rng.standard_normal(4000), rng.standard_normal(4000))]
    rows += [("xx", False, 0.5, 0.5, 400)] * 150 + [("xx", True, 9.0, 9.0, 5)] * 900 + [(None, False, 1.0, 1.0, 50), ("one", False, 1.5, 1.25, 20)]
    df = spark.createDataFrame(rows, "lang string, base_failed boolean, chars_per_byte_token double, chars_per_piece double, n_pieces long")
    bands = fertility.fitted_bands(df, "lang")
    assert set(bands) == {"xx", "one"}
    assert (bands["xx"].least, bands["xx"].least_piece) == pytest.approx((2.0, 3.0), abs=0.01)
    assert (bands["xx"].width, bands["xx"].width_piece) == pytest.approx((2.7, 1.5), rel=0.1)
    assert (bands["one"].least, bands["one"].width) == (1.5, 0.0)
    assert fertility.fitted_bands(df.limit(0), "lang") == {}

"""Wrong decodings and learned pieces against hand-made cases and brute force."""

import itertools
import math

import pytest

from lectern.functions import mojibake
from lectern.operators import retrieval, segments

SOUND = ["café naïve déjà-vu – €5 “so” …", "Größe §5 (±2°) ©2020 ½", "한글 문서입니다. 수강신청 안내", "plain", "", "x²+y³", "Ärger über Öl", "日本語 текст", "Ã", "tab\tand\x00nul", "😀 ok é"]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(t,) for t in SOUND * 3] + [("Le café était très agréable, déjà vu à la fenêtre. " * 20,), ("학교 공지사항 수강신청 안내 문서입니다. " * 20,), (None,)]
    return mojibake.fit(spark.createDataFrame(rows, "text string"))


def test_repaired(model):
    for t in SOUND:
        assert model.repaired(t) == t
    for t in (*SOUND[:3], "Größe Öl"):
        for wrong in ("cp1252", "latin-1", "mac_roman", "cp437"):
            bad = mojibake.misread(t, wrong)
            assert bad != t and model.repaired(bad) == t
        assert model.repaired(mojibake.misread(mojibake.misread(t, "cp1252"), "cp1252")) == t
    assert model.repaired(mojibake.misread(SOUND[2] * 3, "latin-1", "cp949")) == SOUND[2] * 3
    assert model.repaired(None) is None


def test_encodings(spark, model):
    french, korean = "Le café était très agréable, déjà vu à la fenêtre", "학교 공지사항 수강신청 안내 문서입니다"
    for text, names in ((french, ("utf-8", "cp1252", "utf-16-le", "utf-16-be", "mac_roman", "cp437")), (korean, ("utf-8", "cp949", "utf-16-le"))):
        for name in names:
            assert mojibake.read(text.encode(name), model)[1] == text
            assert mojibake.read(text.encode(name), model)[2] > 0.9
    assert mojibake.read(b"\xef\xbb\xbfx", model)[:2] == ("utf-8", "x") and mojibake.read(b"", model)[:2] == ("utf-8", "")
    assert mojibake.read(None, model) == (None, None, 0.0) and mojibake.read(bytes(range(128, 256)) * 4, model)[0] is None
    got = spark.createDataFrame([(bytearray(french.encode("cp1252")),), (None,)], "c binary").select(mojibake.decoded("c", model).alias("x")).select("x.*").collect()
    assert got[0].text == french and got[0].encoding == "cp1252" and got[1].text is None


def _chains(word, lexicon, longest):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(word)]
        pieces = [word[a:b] for a, b in itertools.pairwise(at)]
        if all(p in lexicon and len(p) <= longest for p in pieces):
            yield math.fsum(lexicon[p] for p in pieces), pieces


def test_pieces_against_brute_force(spark):
    words = ["학교에서", "학교는", "학생이", "학생은", "도서관에서", "도서관은", "abab", "ab", "aba", "b", "수업에서", "수업은"]
    df = spark.createDataFrame([(w, 1 + k % 4) for k, w in enumerate(words)], "word string, n long")
    lexicon, told = segments.train(df, size=60, longest=3, least=2, rounds=3, floor=0.0)
    assert len(told) == 4 and all(b >= a - 1e-9 for a, b in itertools.pairwise(told))
    assert math.isclose(sum(map(math.exp, lexicon.values())), 1)
    total = 0.0
    for k, w in enumerate(words):
        every = list(_chains(w, lexicon, 3))
        top = max(p for p, _ in every)
        got = segments.best(w, lexicon, 3)
        assert "".join(got) == w and math.isclose(math.fsum(lexicon[p] for p in got), top)
        likely = math.log(math.fsum(math.exp(p) for p, _ in every))
        p, counts = segments.expected(w, lexicon, 3)
        assert math.isclose(p, likely)
        for piece, c in counts.items():
            assert math.isclose(c, math.fsum(math.exp(q - likely) * x.count(piece) for q, x in every), abs_tol=1e-9)
        total += (1 + k % 4) * likely
    assert math.isclose(told[-1], total)
    assert segments.best("z학교", lexicon, 3)[0] == "z" and segments.best("", lexicon, 3) == [] and segments.best("ab", {}, 3) == ["a", "b"]
    docs = spark.createDataFrame([(1, "학교에서"), (2, "도서관은"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "학교")], "query_id long, text string")
    assert [r.doc_id for r in retrieval.bm25(asked, docs, 3, words=segments.tokenizer(lexicon, 3), grams=()).collect()] == [1]


def test_letters_tell_code_pages_apart(spark):
    """A byte is a letter of one class in several code pages: which letters stand behind which decides (finding 2)."""
    texts = ["für müde Öfen über schöne Böden hören wir " * 8, "le château où l'hôte connaît l'âme être prêt " * 8]
    told = mojibake.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    for t in ("der böse Löwe hört schöne Töne " * 4, "la tête du maître connaît la fête " * 4):
        for name in ("cp437", "mac_roman", "cp1252", "utf-16-le"):
            assert mojibake.read(t.encode(name), told)[1] == t


def test_what_stands_near_a_letter_tells_code_pages_apart(spark):
    """One byte may be all that differs between code pages; the letter ahead fits both readings (round 4, finding 1)."""
    texts = ["Trägen Nägel mähen, Gräben nähren. " * 3, "Genève, Anthène, Hélène et la scène. " * 30, "È vero. " * 2, "les élèves étaient là, é é é. " * 20]
    told = mojibake.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    for t in ("and so on with the word Nägel and no other such letter", "È vero. È vero. È vero. È vero. È vero. È vero."):
        for name in ("cp437", "mac_roman", "cp1252"):
            try:
                assert mojibake.read(t.encode(name), told)[1] == t
            except UnicodeEncodeError:
                assert name == "cp437"


def test_words_are_dealt_over_all_cores(spark):
    words = spark.createDataFrame([(f"w{k}", k + 1) for k in range(50)], "word string, n long").coalesce(1)
    dealt = segments.spread(words)
    assert dealt.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and sorted(dealt.collect()) == sorted(words.collect())

import brute

from corvid.llm import common, linededup
from corvid.llm.linededup import LINES, PARAGRAPHS, remove_repeats

SCHEMA = "doc_id long, text string, row int, n_units string, removed int, pos int"
LINE, OTHER = "one two three four five six", "Another line of more than five words"


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, 7, "x", 1, 2) for i, t in rows], SCHEMA)
    return [(r.record.doc_id, r.text, r.n_units, r.n_removed, [tuple(s) for s in r.removed]) for r in remove_repeats(df, **more).collect()]


def test_earliest_stays_and_offsets_point_into_the_original(spark):
    a, b = f"start\n{LINE}\n{OTHER}", f"{OTHER.upper()}\nshort one\n  ONE two\tthree four five six \nend é\n{LINE}"
    got = {r[0]: r[1:] for r in run(spark, [(2, b), (1, a), (3, "start\nshort one")], units=LINES, min_chars=20)}
    assert got[1] == (a, 3, 0, []) and got[3] == ("start\nshort one", 2, 0, [])
    assert got[2][0] == "short one\nend é\n" and got[2][2] == 3
    assert [b[s : s + n] for s, n in got[2][3]] == [OTHER.upper() + "\n", "  ONE two\tthree four five six \n", LINE]


def test_whole_corpus_with_passages_in_mid_line_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 5)  # frequent digests take the other way
    monkeypatch.setattr(common, "HOT_SHARE", 300)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    passage = " ".join(f"Sentence {k} of a passage that several documents quote in their midst." for k in range(6))
    rows += [(90_000 + k, f"Own words {k} then: {passage} And more words {k} after it.\nLast line {k}. Fin.") for k in range(30)]
    got = {r[0]: (r[1], r[2], r[4]) for r in run(spark, rows)}
    assert got == brute.without_repeats(rows, 160)
    assert got[90_000][2] == [] and all("Sentence 3 of" not in got[90_000 + k][0] and f"Last line {k}. Fin." in got[90_000 + k][0] for k in range(1, 30))


def test_every_position_kept_once_without_a_minimum(spark):
    rows = [(i, "\n".join(f"line {(i * 7 + k) % 40} of the corpus with words" for k in range(9))) for i in range(60)]
    assert {r[0]: (r[1], r[2], r[4]) for r in run(spark, rows, min_chars=0)} == brute.without_repeats(rows, 0)
    unparted = "これは間を空けずに書かれた長い文であり何度も現れる。" * 4
    got = {r[0]: r[1] for r in run(spark, [(1, "あ。" + unparted), (2, "い。" + unparted)], min_chars=60)}
    assert got == {1: "あ。これは間を空けずに書かれた長い文であり何度も現れる。", 2: "い。"}


def test_paragraphs_and_edges(spark):
    got = {r[0]: r[1:] for r in run(spark, [(1, f"{LINE}\n\nx"), (2, f"y\n\n{LINE}\n\n")], units=PARAGRAPHS, min_chars=9)}
    assert got[2] == ("y\n\n", 3, 1, [(3, len(LINE) + 2)])
    rows = [(5, None), (6, ""), (7, LINE), (7, LINE), (None, LINE), (8, "\n" * 50_000 + LINE), (9, " \n\n ")]
    got = sorted(run(spark, rows, min_chars=0), key=str)
    assert [r[3] for r in got if r[0] == 7] in ([0, 1], [1, 0])
    assert [r for r in got if r[0] == 5] == [(5, None, 0, 0, [])] and [r for r in got if r[0] == 6] == [(6, "", 1, 0, [])]
    assert [r[3] for r in got if r[0] in (None, 8)] == [1, 1] and [r[1] for r in got if r[0] == 9] == [" \n\n "]
    assert run(spark, []) == []
    # a blank line doesn't part a run, another unit does
    assert linededup.removable([(0, 5), (2, 5), (4, 5)], [False, True, False, False, False], 10) == [0, 2]

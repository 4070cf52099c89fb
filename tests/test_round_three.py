import random

from cuestrata.functions.edits import edit_distances


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_edit_distances_side_by_side_and_alone():
    pick = random.Random(3)
    word = lambda: "".join(pick.choice(letters) for _ in range(pick.choice([0, 1, 5, 63, 64, 65, 128, 129, 200])))
    for letters in ("ab", "abcdef é中😀\0"):
        a, b = [word() for _ in range(300)], [word() for _ in range(300)]
        want = [plain(x, y) for x, y in zip(a, b)]
        assert edit_distances(a, b).tolist() == want
        assert [int(edit_distances([x], [y])[0]) for x, y in zip(a[:60], b[:60])] == want[:60]
    assert edit_distances([], []).tolist() == []


def test_token_keys_of_a_whole_line(spark):
    from cuestrata.functions import repair as R

    df = spark.createDataFrame([("«Go» go, GO! ... ... !? -- --",), ("(a) b-c «A» B-C é É",), ("no  --x-- X",)], "text string")
    assert [r.text for r in R.collapse_token_loops(df).collect()] == ["«Go» ... !? --", "(a) b-c é É", "no --x--"]


def test_files_of_a_folder_are_one_recording(spark, tmp_path):
    from cuestrata.sources.srt import read_srt

    folder = tmp_path / "recording_id=7"
    folder.mkdir()
    for part, numbers in enumerate(((1, 2), (3, 4))):
        (folder / f"part-0000{part}.txt").write_text("".join(f"{n}\n00:00:0{n},000 --> 00:00:0{n},500\nt{n}\n\n" for n in numbers))
    rows = read_srt(spark, str(tmp_path), folders=True).orderBy("pos").collect()
    assert [(r.pos, r.idx, r.text) for r in rows] == [(0, 1, "t1"), (1, 2, "t2"), (2, 3, "t3"), (3, 4, "t4")]


def test_rules_are_looked_for_before_their_patterns(spark):
    """One pattern in the plan, not one for each rule."""
    from cuestrata.functions import repair as R

    df = spark.range(1).selectExpr("concat('I''M''S it, the''s ', id) AS text")
    plan = R.repair_grammar(R.repair_contractions(df))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") < 12
    assert R.repair_contractions(df).first()[0] == "I'm it, There's 0"


def test_loops_skip_lines_that_repeat_nothing(spark):
    from cuestrata.functions import repair as R

    df = spark.createDataFrame([(" a  b\tc ",), (" one ",), ("",), ("a, (a) b",), ("x b a b a y",), (None,)], "text string")
    assert [r.text for r in R.collapse_token_loops(df).collect()] == ["a b c", " one ", "", "a, b", "x b a y", None]


def test_name_words_are_white_space_tokens(spark):
    from cuestrata.operators.names import canonical_names, name_words

    rows = [(1, 0, " «Anna,  bAnna -- xAnna"), (1, 1, "Anna\tAnnb  Annb's"), (1, 2, "Ünal. -")]
    df = spark.createDataFrame(rows, "recording_id int, pos int, text string")
    assert {(r.word, r.freq) for r in name_words(df).collect()} == {("Anna", 2), ("Annb", 1), ("Annb's", 1), ("Ünal", 1)}
    got = [r.text for r in canonical_names(df).orderBy("pos").collect()]
    assert got == [" «Anna,  bAnna -- xAnna", "Anna\tAnna  Anna's", "Ünal. -"]


def test_short_ways_of_ascii_lines_agree_with_the_patterns(spark):
    from pyspark.sql import functions as F

    from cuestrata.functions import text as T

    texts = ["", " ", "a b", " a b ", "a  b", "a\tb\x0b", "\r\na\f", "a\x1cb", "é b", "é　 b ", "か な", "A-z_'9 é漢字[x]"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    flat = F.trim(F.regexp_replace("text", f"{T.WS}+", " "))
    both = [
        (T.collapse("text"), flat), (T.collapse(F.col("text")), flat),
        (T.strip("text") != "", flat != ""), (T.solid_chars("text"), F.length(F.regexp_replace("text", T.WS, ""))),
        (T.japanese_chars("text"), F.length(F.regexp_replace("text", f"[^{T.SCRIPT}]", ""))),
        (T.source_key("text"), F.regexp_replace("text", f"[^A-Za-z0-9{T.SCRIPT}]", "")),
        (T.target_key("text"), F.trim(F.regexp_replace(T.ascii_lower("text"), "[^a-z0-9']+", " ")))]
    for row in df.select(*[a.eqNullSafe(b) for a, b in both]).collect():
        assert all(row)
    patterns = df.select(T.source_key("text"), T.target_key("text"))._jdf.queryExecution().analyzed().toString()
    assert "[^" not in patterns  # negated classes take several times as long

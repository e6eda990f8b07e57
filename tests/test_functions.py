"""Scalar functions on single values."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions import names as n
from quillframe.functions import prose
from quillframe.functions import text as t
from quillframe.functions import unicode as u
from quillframe.functions import values as v


def check(spark, cases):
    """All columns of the cases are evaluated in one row."""
    row = spark.range(1).select(*(c.alias(f"c{k}") for k, (c, _) in enumerate(cases))).first()
    for k, (_, want) in enumerate(cases):
        got = row[f"c{k}"]
        assert plain(got) == want, (k, got, want)


def plain(x):
    if isinstance(x, list):
        return [plain(y) for y in x]
    return tuple(plain(y) for y in x) if isinstance(x, tuple) else x


def s(f, x, *more):
    return f(F.lit(x), *more)

def test_columns(spark):
    cases = [
        (s(t.sanitize_filename," a/b: c*d  "), "ab_cd"),
        (s(t.sanitize_filename,"con"), "_con"),(s(t.sanitize_filename," .. "),"untitled"),
        (s(t.without_promotions,"a\r\n\n Share this STORY \nb"),"a\n\nb"),
        (s(t.clean_line," a\xa0\n b"+chr(0xfeff)),"a b"),
        (s(t.title_key," It"+chr(0x2019)+"S "),"it's"),
        (s(t.title_key_words,"Tom & Jerry's"),"tom and jerrys"),
        (s(t.query_variants,"Bob's  & Co"),["Bob's & Co","Bob & Co","Bobs & Co","Bob s and Co"]),
        (s(t.comparable,"<p>a  b</p><br/>c"),"a b\nc"),
        (s(t.plain_from_markdown,"**a** *b*\n\n\nc\nd"),"a b\nc\nd"),
        (s(t.segment_html,"**bold**\nx\n\ny"),"<p><em>*bold</em>*<br>x</p><p>y</p>"),
        (s(t.speech_text,"a<b>\\n c\nd"),"a c d"),
        (s(t.is_garbage,"Chapter 12"),True),(s(t.is_garbage,"He went home and slept well."),False),
        (s(t.is_thin,"a b c"),True),(s(t.is_thin," ".join(["w"]*20)),False),
        (s(t.chunks,"Aaa. Bbb. Ccc.",8),["Aaa. Bbb.","Ccc."]),
        (s(t.chunks,"ab. one two three four five six.",10),["ab.","one two.","three.","four five.","six.."]),
        (s(t.halves,"a b c"),["a","b c"]),
        ((t.body_paragraphs(F.array(*map(F.lit,["junk","Chapter 3: X","a","b","c","In this moment all","What to expect in the next"])))),["a","b","c"]),
        ((t.without_echoes(F.array(F.lit("Prologue"),F.lit("Text")),F.lit("Chapter 0: Prologue"),F.lit("S"))),["Text"]),
        (s(t.bare,"**a**"),"a"),
        (s(v.compact_number,"12.5K"),12500),(s(v.compact_number,"1,204"),1204),(s(v.compact_number,"x"),None),
        (s(v.as_int,"30.0"),30),(s(v.as_int,"x"),0),(s(v.retry_after,"-3"),0.0),(s(v.retry_after,""),None),
        (s(v.local_time,"2024-01-02 03:04:05").cast("string"),"2024-01-02 03:04:05"),(s(v.local_time,"2024-01-02T03:04:05"),None),
        ((v.duration_label(F.lit(3725.0))),"1h 2m"),((v.rate_label(F.lit(1234.4))),"1,234 ch/h"),
        (s(v.split_tags,"a, b;c| "),["a","b","c"]),(s(v.title_list,' "A b" ; c '),["A b","c"]),
        (s(v.story_urls,"see https://jobnib.com/book/abc/?x and http://www.jobnib.com/book/abc, https://jobnib.com/book/z-chapter-3"),["https://jobnib.com/book/abc"]),
        (s(v.canonical_url,"http://a/b/?q#f"),"http://a/b"),(s(v.slug,"https://x.com/novel/abc-chapter-12/"),"abc"),(s(v.slug,"abc"),"abc"),
        (s(v.host_suffixes,"https://a.b.com/x"),["a.b.com","b.com"]),
        (s(v.error_status,"HTTP 429 now"),"queued"),(s(v.is_recoverable,"Timed out"),True),
        (s(v.log_event,"[s/10] Crawled chapter 3: T")["kind"],"segment"),(s(v.log_event,"[s/10] Crawled chapter 3: T")["total"],10),
        (s(v.log_tone,"HTTP 403"),"error"),(s(v.log_parts,"12:00:01 hi")["message"],"hi"),
        (s(v.cookies,"Cookie: a=1; b=2=3; a=4; x"),[("a","4"),("b","2=3")]),
        (s(v.asset_variants,"cover1"),["cover1.jpg","cover1.png"]),
        ((v.output_name(F.lit(""),F.lit("n"),F.lit(True))),"n_Completed"),
        (s(v.page_numbers,"4.8 66 reviews and 12.5K reads"),(4.8,66,12500)),
        ((v.tail(F.array(*map(F.lit,[1,2,3])),2)),[2,3]),((v.without_key(F.lit('{"a":1,"b":"x"}'),"a")),'{"b":"x"}'),
        (s(n.item_title,"DONE_x_wp - My_Title  A"),"My Title A"),(s(n.item_title,"DONE_Title_gd"),"Title"),(s(n.item_prefix,"EXTENDED_a"),"EXTENDED"),(s(n.item_prefix,"a"),"UNKNOWN"),
        (s(n.item_platform,"DONE_a_gd - T"),"Goodnovel"),(s(n.item_platform,"DONE_a - T"),None),
        (s(n.upload_format,"DONE_a_max - T"),(False,"max",None)),(s(n.upload_format,"DONE_a_wp - T"),(True,"wp","Wattpad")),
        (s(n.segment_ordinal,"chapter 12 - x.md"),12),(s(n.is_segment_name,"Chapter 1.md"),False),(s(n.segment_title,"Chapter 1 - A_b.md"),"A b"),
        (s(n.category_names,"# h\nRomance\nFantasy"),("romance","fantasy")),(s(n.category_id,"LGBTQ+"),"8dabb3e8-3e6c-4b20-9b48-cb7bd028cecf"),
        (s(n.push_message,"Title: a\ncontent: b"),("a","b")),(s(n.synopsis,"# Synopsis\na\nb\n# Tags\nc"),"a b"),(s(n.tag_list,"a, 'b'\nc d"),["a","b","c","d"]),
        (s(n.max_segment,"Chapter 99"),99),(s(n.max_segment,"invalid"),None),(s(n.length_kind,"Long\nx"),"long"),
    ]
    check(spark, cases)


def test_python_backed(spark):
    df = spark.createDataFrame([("A &amp;  B", "\uff21 b\u200b", "abcd", "bcde", "A!", "a")], ["a", "b", "c", "d", "e", "f"])
    row = df.select(u.title_key_unescaped(F.col("a")).alias("k"), u.visible("b").alias("v"), u.title_likeness(F.col("c"), F.col("d")).alias("x"), u.title_likeness(F.col("e"), F.col("f")).alias("y")).first()
    assert tuple(row) == ("a & b", "A b", 0.75, 1.0)


def test_cards_and_page_text(spark):
    page = '<article><h4><a href="/stories/111">T</a></h4> by Jane Doe \u2022 Complete \u2022 20 chapters Show Reviews (66)</article><script>x</script>'
    df = spark.createDataFrame([(page,), (None,)], "h string").select(u.cards("h").alias("c"), u.page_text("h").alias("t"))
    rows = df.select(u.story_cards(F.col("c")).alias("o"), "t", prose.prose_share(F.col("t")).alias("p")).collect()
    assert plain(rows[0]["o"]) == [("111", "T", "Jane Doe", 20, 66)] and "x" not in rows[0]["t"].split("\n")
    assert rows[1]["o"] == [] and rows[1]["t"] == "" and rows[1]["p"] is None


def test_differences(spark):
    pairs = [("a", F.lit("x"), F.lit("y")), ("b", F.lit(None).cast("string"), F.lit("y")), ("c", F.lit(None).cast("string"), F.lit("z"))]
    row = spark.range(1).select(n.differences(pairs, ("c",)).alias("d"), n.same_set(F.array(F.lit("A "), F.lit("b")), F.array(F.lit("B"), F.lit("a"), F.lit(""))).alias("s")).first()
    assert plain(row["d"]) == [("a", "x", "y"), ("c", None, "z")] and row["s"]


def test_promotional_lines_are_patterns(spark):
    df = spark.createDataFrame([("Read at innread.com now\nA line.\nSearch this tale on Google\nSHARE THIS STORY\nit (is) so\nx innreadxcom",)], "t string")
    assert df.select(t.without_promotions("t", ("(is)",))).first()[0] == "A line.\n\nx innreadxcom"


def test_recursive_halving(spark):
    rows = [("a b c d e f g h",), ("abcdefghij",), ("",), ("one two",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(t.split_to("t", 4)).collect()]
    assert got == [["a b", "c d", "e f", "g h"], ["abcdefghij"], [], ["one", "two"], []]

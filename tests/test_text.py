"""Sentences, tokens, classes of characters, and the steps from markup to text."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lumenlex.functions import markup as M
from lumenlex.functions import text as X


def each(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["x"] for r in rows.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_sentences(spark):
    found = each(spark, ["አለ። ሄደ፧ yes! no?\nlast. one 3.5 ።።", "", None, " \n ! "], X.split_sentences)
    assert found == [["አለ", "ሄደ", "yes", "no", "last. one 3.5"], [], [], []]


def test_tokens(spark):
    found = each(spark, ["ደቡብ-ምዕራብ, ab​c 12.5 ፡x፣ CamelCase", "ዓ.ም እ.ኤ.አ ዶ.ር ab.cd", "", "ሀ.ለመ"], X.tokenize)
    assert found == [["ደቡብ", "ምዕራብ", "ab", "c", "12", "5", "x", "CamelCase"], ["ዓም", "እኤአ", "ዶር", "ab", "cd"], [], ["ሀ", "ለመ"]]


def test_tokens_follow_the_definition_on_random_strings(spark):
    rng = random.Random(5)
    alphabet = "ab ሀለሐ.፡።-1 ​𝒳é_\t$"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(400)]

    def expected(s):
        letter = "[ሀ-ፚ]"
        s = re.sub(f"(?<!{letter}){letter}(?:\\.{letter})+(?!{letter})", lambda m: m[0].replace(".", ""), s)
        apart = lambda c: c.isspace() or unicodedata.category(c)[0] in "PSZ" or unicodedata.category(c) in ("Cc", "Cf")
        return "".join(" " if apart(c) else c for c in s).split()

    assert each(spark, texts, X.tokenize) == [expected(s) for s in texts]


def test_classes_of_characters(spark):
    found = each(spark, ["ሀ", "፩", "a", "Z", "7", "é", "א", "፛"], X.character_bucket)
    assert found == ["ethiopic_letters", "ethiopic_numerals", "ascii_letters", "ascii_letters", "ascii_digits", "other", "other", "other"]
    assert each(spark, ["é", "א", "𝒳"], X.code_point_label) == ["U+00E9", "U+05D0", "U+1D4B3"]
    assert each(spark, ["abcሀ", "abc", "፩2", "ᎀ"], X.has_ethiopic_letter) == [True, False, False, False]


@pytest.mark.parametrize(
    "step, given, wanted",
    [
        (M.remove_comments, "a<!-- x\ny -->b<!--open", "ab"),
        (M.remove_references, 'a<ref name="x"/>b<REF>c</ref >d<ref>e', "abd"),
        (lambda t: M.remove_nested(t, "{{", "}}"), "a{{b|{{c}}}}d}} e{{f", "ad}} e"),
        (lambda t: M.remove_nested(t, "{|", "|}"), "a{| x {| y |} |}b{c|d}", "ab{c|d}"),
        (M.replace_links, "[[a]] [[b|c]] [[d|e|f]] [[g|]] [[ | ]]", "a c f g  "),
        (M.replace_links, "x[[File:a.png|[[b]] c]]y[[en:z]][[Category:q]][[:Category:k]] [[wikt:w]]", "xy:Category:k wikt:w"),
        (M.replace_links, "[[ፋይል:a|b]]ሀ [[open [[in|ner]]", "ሀ open ner".replace("open", "[[open".lstrip("["))),
        (M.replace_links, "[[a|b [[c|d]] e]]", "d]] e"),
        (M.replace_external_links, "[http://a.b label c] [https://x] see ftp://y/z end", "label c  see   end"),
        (M.remove_tags, "a<br/>b<BR >c<b class='x'>d</b> 1 < 2", "a\nb\ncd 1 < 2"),
        (M.decode_entities, "&amp;&lt;b&gt;&nbsp;&#4608;", "&<b> ሀ"),
        (M.remove_emphasis, "'''a''' it's __TOC__ __x__", "a it's  __x__"),
        (M.clean_lines, " == h ==\n* one\n\n|cell\n!head\n#: two \n;;\nthree", "one\ntwo\nthree"),
    ],
)
def test_markup_steps(spark, step, given, wanted):
    assert each(spark, [given, None], step) == [wanted, None]


def test_deep_links_and_many_blocks():
    """Neither nesting nor the number of marks is bounded."""
    assert M.link_text("[[" * 5000 + "x" + "]]" * 5000) == "x"
    assert M.outside_blocks("a{{b}}" * 100_000, "{{", "}}") == "a" * 100_000
    assert M.outside_blocks("{{" * 50_000 + "}}" * 50_000 + "end", "{{", "}}") == "end"


def test_all_steps_in_order(spark):
    rows = spark.createDataFrame([("ከተማ", "{{Info|x={{y}}}}'''{{PAGENAME}}''' [[a|ናት]]።<ref>r</ref>\n== H ==\n* &lt;b&gt; [http://u ል]<!-- c -->")], "title string, t string")
    assert rows.select(M.strip_markup(F.col("t"), F.col("title")).alias("x")).first()["x"] == "ከተማ ናት።\n<b> ል"


def test_nested_blocks_against_a_scan(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["{{", "}}", "{", "}", "a", "|", "\n"]) for _ in range(rng.randint(0, 18))) for _ in range(500)]

    def scan(t):
        out, depth, i = [], 0, 0
        while i < len(t):
            two = t[i : i + 2]
            if two == "{{":
                depth, i = depth + 1, i + 2
            elif two == "}}" and depth:
                depth, i = depth - 1, i + 2
            elif two == "}}":
                out.append(two)
                i += 2
            else:
                if not depth:
                    out.append(t[i])
                i += 1
        return "".join(out)

    assert each(spark, texts, lambda t: M.remove_nested(t, "{{", "}}")) == [scan(t) for t in texts]


def test_few_texts_are_python_strings_at_once(spark, monkeypatch):
    monkeypatch.setattr(M, "TEXTS", 2)
    texts = [None, "", "a &amp; b", "&lt;x&gt;&nbsp;", None, "ሀ &#x1200;", "plain"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").coalesce(1)
    found = [r["text"] for r in rows.select("id", M.decode_entities(F.col("text")).alias("text")).orderBy("id").collect()]
    assert found == [None, "", "a & b", "<x> ", None, "ሀ ሀ", "plain"]

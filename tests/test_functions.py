from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleanery.functions import text, titles, urls
from gleanery.functions.regex import to_java, to_java_replacement
from gleanery.sources import wordlists


# ------------------------------------------------------------------- patterns

def test_names_become_positions():
    p = to_java(r'(a)(?<x>b)(?:c)(?<y>[(]d)\((?<x>e)')
    assert p.groups == {"x": [2, 4], "y": [3]}
    assert p.java == r"(?d)(a)(b)(?:c)([(]d)\((e)"


def test_numbered_references_follow_the_dotnet_order():
    # Plain groups are numbered before named ones.
    assert to_java(r"(?<n>a)(b)\1\2\k<n>").java == r"(?d)(a)(b)\2\1\1"


@pytest.mark.parametrize("pattern, alone", [
    (r"<a>(?<x>.*?)</a>", True), (r"(?<=<a>)x", False), (r"^x", False), (r"x\b", False), (r"a[$^]b", True), (r"(?>a)b", False)])
def test_patterns_that_look_around(pattern, alone):
    assert to_java(pattern).self_contained is alone


def test_empty_pattern_is_disabled():
    assert not to_java("").enabled and not to_java(None).enabled


def test_shorthand_classes_are_unicode(value):
    assert value(lambda c: F.regexp_replace(c, to_java(r"\w+").java, "_"), "中文 é_9-x") == "_ _-_"
    assert value(lambda c: F.regexp_replace(c, to_java(r"[\s]+").java, "_"), "a　 b") == "a_b"
    assert value(lambda c: F.regexp_replace(c, to_java(r"[^\w]").java, "_"), "é-中") == "é_中"
    assert value(lambda c: F.regexp_replace(c, to_java(r"[\W&&x[]").java, "_"), "aé-[&x") == "aé____"


def test_dot_stops_at_line_feed_only(value):
    assert value(lambda c: F.regexp_extract(c, to_java("<(?<a>.*?)>").java, 1), "<a\rb c>") == "a\rb c"
    assert value(lambda c: F.regexp_extract(c, to_java("<(?<a>.*?)>").java, 1), "<a\nb>") == ""


def test_replacement_backslash_is_text(value):
    assert value(lambda c: F.regexp_replace(c, "(b)", to_java_replacement(r"\n$1")), "abc") == r"a\nbc"


def test_functions_travel_to_workers_without_the_package(tmp_path):
    """A worker elsewhere unpickles them by value."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    data = cloudpickle.dumps(lambda p: to_java(p).java)
    code = f"import pickle; print(pickle.loads({data!r})('(?<a>x)'))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "(?d)(x)", done.stderr


# ----------------------------------------------------------------------- text

def run_filter(spark, s, steps=None, replace_list=()):
    df = spark.createDataFrame([(s,)], "t string")
    df = text.content_filter(df, "t", replace_list) if steps is None else text.apply_steps(df, "t", steps)
    return df.first()["t"]


@pytest.mark.parametrize("raw, clean", [
    ("<<p>p>x", "x"),
    ("<<p>div>x", "<div>x"),  # tags go one after the other
    ("<a href\nx>y\n</a>z", "z"),
    ("<A HREF>y</A>z", "z"),
    ("&#39;&amp;lt;", "&39;&amp;lt;"),
    ("ＡＢＣ１２３　！", "abc123 !"),
    ("看abc.com吧", "吧"),
    ("看 中文站点.net 吧", "看  吧"),
    ("hthttp://tp://x", "x"),
    ("<strong>书名简单介绍:</strong>x", "x"),
    ("<td class>x</td>", "<td class>x"),
])
def test_content_filter(spark, raw, clean):
    assert run_filter(spark, raw) == clean


def test_filter_is_exact_beyond_the_unrolled_rounds(spark):
    deep = "<" * 40 + "p>" * 40
    assert run_filter(spark, deep + "x", text.DROP_BARE_TAGS) == "x"
    assert run_filter(spark, "<a " * 30 + "</a>" * 30 + "x", text.DROP_BLOCKS) == "</a>" * 29 + "x"


def test_filter_is_idempotent(spark):
    raw = "<p>Ａ【b】 www.site.com <script x>1</script> <<div>div> http://x.org/a"
    once = run_filter(spark, raw)
    assert run_filter(spark, once) == once


def test_replace_list_file(spark):
    lines = wordlists.split_lines(
        spark.createDataFrame([("foo\r\nbar|BAZ\r\nqux|q|ignored\r\n|x\r\n\r\na|a",)], "v string"), "v")
    rules = wordlists.load_replace_list(wordlists.replace_rules(lines))
    assert rules == [("foo", ""), ("bar", "BAZ"), ("qux", "q"), ("a", "a")]
    df = text.apply_replace_list(spark.createDataFrame([("FOO fffoooo bar quxa",), ("x",)], "t string"), "t", rules, "loops")
    assert [tuple(r) for r in df.collect()] == [(" f BaZ qa", True), ("x", False)]


def replaced(spark, rows, rules):
    df = text.apply_replace_list(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string"), "t", rules, "endless")
    assert df.columns == ["i", "t", "endless"]
    return [(r["t"], r["endless"]) for r in df.orderBy("i").collect()]


def test_a_rule_may_make_a_text_much_longer(spark):
    # Each round takes one x off and doubles the b's: 4,096 of them, more than the rounds of one pass.
    rules = [("xb", "bb"), ("x(b+)", "$1$1"), ("c", "d")]
    assert replaced(spark, ["x" * 12 + "c", "xc", None, "c"], [("x{3}", "yx"), ("xx|x(?=c)", "z")])[2:] == [(None, False), ("c", False)]
    grown = replaced(spark, ["x" * 11 + "b" + "c", "c"], rules[1:])
    assert grown == [("b" * 2 ** 11 + "d", False), ("d", False)]


@pytest.mark.parametrize("rules", [[("a", "ba")], [("a", "a")], [("ab", "xabx")], [("a", "$0$0")], [("ab", "c"), ("c", "ab$9x".replace("$9", ""))]])
def test_rules_without_end(spark, rules):
    got = replaced(spark, ["ab", "no"], [*rules, ("n", "m")])
    assert got[1] == ("mo", False)
    # Two rules that undo each other do end, as each is done before the next begins.
    assert got[0][1] == (len(rules) == 1)


def test_a_text_that_comes_back_to_a_state_has_no_end(spark):
    # The replacement holds no match by itself, the text around it makes one: a-b and b-a for ever.
    rules = [(r"^(a)(b)|^(b)(a)(?=!)", "$2$1$4$3")]
    (text_now, endless), other = replaced(spark, ["ab!", "x"], rules)
    assert endless and other == ("x", False)


def test_only_waiting_texts_go_on(spark, monkeypatch):
    written = []
    plain = text.write_out
    monkeypatch.setattr(text, "write_out", lambda df, label: written.append(df) or plain(df, label))
    rows = ["a" * 3000] + ["none"] * 50
    assert replaced(spark, rows, [("aa", "a")])[0] == ("a", False)
    assert [d.count() for d in written] == [51, 1]


def test_replacement_test_is_case_sensitive(spark):
    assert run_filter(spark, "X x", [text.replace_step("x", "y")]) == "y y"
    assert run_filter(spark, "X", [text.replace_step("x", "y")]) == "X"


@pytest.mark.parametrize("raw, decoded", [
    ("&lt;b&gt; &amp;lt; &unknown; & a&b;c", "<b> &lt; &unknown; & a&b;c"),
    ("&#39;&#x4e2d;&#X1F600;&#0;&#xD800;", "'中😀&#0;&#xD800;"),
    ("no entity", "no entity"), ("&nbsp;&copy;&apos;", " ©'"), ("&", "&"),
])
def test_html_decode(value, raw, decoded):
    assert value(text.html_decode, raw) == decoded


@pytest.mark.parametrize("raw, decoded", [
    ("a%7Cb+c", "a|b c"), ("bad%zz+", "bad%zz+"), (r"你好 😀 \u12", "你好 😀 \\u12"), ("%E4%BD%A0", "你")])
def test_media_decode(value, raw, decoded):
    assert value(text.media_decode, raw) == decoded


def test_small_conversions(value):
    assert [value(text.to_int, s) for s in ("12", "12a", "", "-3")] == [12, 0, 0, -3]
    assert [value(text.status_code, s) for s in ("连载中", "完本", "")] == [0, 1, 1]
    assert value(lambda a: text.first_filled(a, F.lit(None), "z"), "") == "z"
    assert value(text.trim_dots, "a.b...") == "a.b"
    assert value(text.strip_tags, "a<b c='d'>e</b>") == "ae"
    assert value(lambda c: text.strip_site_name(c, F.lit("站")), "某站x") == "某x"


# --------------------------------------------------------------------- titles

@pytest.mark.parametrize("raw, title, known", [
    ("第1章-第3章", "第1章-第3章", True), ("【第12章】 甲乙", "【第12章】 甲乙", True), ("x第12章 甲乙", "第12章 甲乙", True),
    ("第一百章", "第一百章", True), ("12-15章", "12-15章", True), ("第7", "第7", True), ("7. 甲乙", "7", True),
    ("完本后记", "完本后记", True), ("大结局", "大结局", True), ("第1章 甲【紧急!】", "第1章 甲", True),
    ("第1章 甲(求票)", "第1章 甲", True), ("第1章 甲(上)", "第1章 甲(上)", True), ("无编号", "无编号", False),
    ("无编号【求月票】", "无编号", False)])
def test_chapter_title(value, raw, title, known):
    assert tuple(value(titles.chapter_title, raw)) == (title, known)


@pytest.mark.parametrize("raw, title", [("a//b", "a/b"), ("a///b:c", "a/b_c"), ("a:b|c", "a_b_c"), ("<x>*?", "x")])
def test_standard_title(value, raw, title):
    assert value(titles.standard_title, raw) == title


@pytest.mark.parametrize("name, series, full, basic", [
    ("Show01.rmvb", "Show", "第01集", "第01集"),
    ("[www.x.com]Show_02国语.avi", "Show", "第02集", "[]02国语"),
    ("Show.rmvb", "Show", "", ""),
    ("Show(版)-3.mp4", "Sh(ow)版", "第3集", "show(版)-3"),
])
def test_episode_title(value, name, series, full, basic):
    assert value(titles.episode_title, name, series) == full
    assert value(titles.episode_title_basic, name, series) == basic


def test_media_link_parts(value):
    assert value(titles.media_file_name, "bdhd://1|2|x.avi") == "x.avi"
    assert value(titles.media_file_name, "bdhd://1|2.avi") is None
    assert value(titles.media_kind, "bdhd://1") == "baidu" and value(titles.media_kind, "qvod://1") == "qvod"


# ----------------------------------------------------------------------- URLs

@pytest.mark.parametrize("link, base, absolute", [
    ("http://x/y", "http://a/b", "http://x/y"), ("/y", "http://a/b/c", "http://a/y"), ("//x/y", "https://a/b", "https://x/y"),
    ("y", "http://a/b/c.html?q=/z", "http://a/b/y"), ("y", "http://a", "http://a/y"), ("?q", "http://a/b?p#f", "http://a/b?q"),
    ("#f", "http://a/b?p#g", "http://a/b?p#f"), ("", "http://a/b", ""), ("../y", "http://a/b/c", "http://a/b/../y")])
def test_resolve(value, link, base, absolute):
    assert value(urls.resolve, link, base) == absolute


@pytest.mark.parametrize("url, key", [
    ("HTTP://A.b:80", "http://a.b/"), ("https://a:443/x#f", "https://a/x"), ("http://a:8080/", "http://a:8080/"),
    ("http://a/b/../c/./d/..", "http://a/c/"), ("http://a/../x?y=/../z", "http://a/x?y=/../z"), ("rel/x", "rel/x")])
def test_url_key(value, url, key):
    assert value(urls.url_key, url) == key

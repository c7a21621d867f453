"""Small invented sites that exercise the jobs."""

from __future__ import annotations

from gleanery.schemas import BOOK_RULE, PAGE, SERIES_RULE


def _rule(spark, ddl, values):
    names = [c.split()[0] for c in ddl.split(", ")]
    return spark.createDataFrame([tuple(values.get(n) for n in names)], ddl)


BOOK = {
    "Name": "books", "SiteName": "书站", "SiteDomain": "b.example", "TargetSiteUrl": "http://t.example/",
    "CharSet": "utf-8", "ListUrl": "http://b.example/list1.html",
    "ListRule": r'<li><a href="(?<url>.*?)">(?<title>.*?)</a></li>',
    "ListUrlNextRule": r'(?<=<a class="next" href=").*?(?=")',
    "InfoRule": r'<h1>(?<title>.*?)</h1><b>(?<author>.*?)</b><i>(?<status>.*?)</i><u>(?<length>.*?)</u>'
                r'<em>(?<cls>.*?)</em><div>(?<intro>[\s\S]*?)</div>(<img src="(?<image>.*?)">)?',
    "ChapterListUrlRule": r'(?<=<a class="toc" href=").*?(?=")',
    "ChapterListRule": r'<dd><a href="(?<url>.*?)">(?<title>.*?)</a></dd>',
    "ContentRule": r"<h2>(?<title>.*?)</h2><article>(?<content>[\s\S]*?)</article>",
    "NextContentRule": r'(?<=<a class="more" href=").*?(?=")',
    "NextChapterUrlRule": r'(?<=<a class="onward" href=").*?(?=")',
    "FaceWidth": 120, "FaceHeight": 142,
}


def book_rules(spark, **changes):
    return _rule(spark, BOOK_RULE, {**BOOK, **changes})


def item(tag, url, title):
    return f'<{tag}><a href="{url}">{title}</a></{tag}>'


def info(title, author, cls, chapters="", toc="", image="", status="连载中", length="12a", intro="<p>说明 www.abc.com</p>"):
    img = f'<img src="{image}">' if image else ""
    link = f'<a class="toc" href="{toc}">目录</a>' if toc else ""
    return (f"<h1>{title}</h1><b>{author}</b><i>{status}</i><u>{length}</u><em>{cls}</em><div>{intro}</div>{img}"
            f"{link}{chapters}")


def chapter(title, content, more="", onward=""):
    link = f'<a class="more" href="{more}">more</a>' if more else ""
    link += f'<a class="onward" href="{onward}">next</a>' if onward else ""
    return f"<h2>{title}</h2><article>{content}</article>{link}"


def book_pages(spark, *, extra_chapters=(), without=()):
    """Two lists, three books and one on the blacklist, chapters in parts."""
    a = "".join(item("dd", f"/a/{n}.html", f"第{n}章 甲") for n in range(1, 4))
    a += "".join(item("dd", f"/a/{n}.html", f"第{n}章 甲") for n in extra_chapters)
    pages = {
        "/list1.html": item("li", "/a.html", "甲书") + item("li", "/bad.html", "黑书")
                       + '<a class="next" href="/list2.html">',
        "/list2.html": item("li", "b.html", "乙书") + item("li", "/none.html", "无页") + item("li", "/odd.html", "怪")
                       + '<a class="next" href="/list1.html">',
        "/a.html": info("甲书", "张三", "玄幻", chapters=a, image="/a.jpg"),
        "/b.html": info("乙书", "", "武侠", toc="/b/toc.html", status="完本", length="345"),
        "/odd.html": "<h1>nothing here</h1>",
        "/b/toc.html": item("dd", "/b/1.html", "一") + item("dd", "/b/2.html", "二") + item("dd", "/b/3.html", "三"),
        "/a/1.html": chapter("第1章 甲", "<p>一&amp;</p>", more="/a/1b.html"),
        "/a/1b.html": chapter("", "<p>二</p>", more="/a/1c.html"),
        "/a/1c.html": chapter("", "<p>三</p>", more="/a/1.html"),
        "/a/2.html": chapter("第2章 甲", "<p>ＡＢ（x）</p>"),
        "/a/3.html": chapter("第3章 甲", "third"),
        "/b/1.html": chapter("一", "b one", onward="/b/1x.html"),
        "/b/1x.html": chapter("一续", "b one more"),
        "/b/3.html": chapter("三", "b three"),
    }
    pages |= {f"/a/{n}.html": chapter(f"第{n}章 甲", f"text {n}") for n in extra_chapters}
    rows = [(i, f"http://b.example{u}", h) for i, (u, h) in enumerate(pages.items()) if u not in without]
    # An older copy of a page, which must not count.
    rows.append((-1, "http://b.example/a.html", info("旧书", "张三", "玄幻")))
    return spark.createDataFrame(rows, PAGE)


SERIES = {
    "Name": "series", "SiteName": "某影院", "Encoding": "gb2312", "ListPageUrl": "http://s.example/new/list.html",
    "NextListRule": r'<a rel="next" href="(?<key>.*?)">',
    "ListInfoRule": r'<h3 class="film"><a href=(?<url>\S*?) lang=zh>(?<title>.*?)</a></h3>',
    "InfoRule": r'<a href="/c">(?<class>.*?)</a>[\s\S]*?<img src="(?<image>.*?)"/>[\s\S]*?《(?<title>.*?)》[\s\S]*?'
                r'类型: (?<class>.*?) 地区: (?<location>.*?) <p>(?<intro>[\s\S]*?)</p>',
    "KuaibAreaRule": r"<h2>qvod</h2>(?<key>[\s\S]*?)</ul>",
    "BaiduAreaRule": r"<h2>baidu</h2>(?<key>[\s\S]*?)</ul>",
    "KuaibDramaRule": r"<li q='(?<url>.*?)'>(?<title>.*?)</li>",
    "BaiduDramaRule": r"<em data-play='(?<playurl>.*?)'>(?<title>.*?)</em>",
    "DramaPageKuaibRule": "",
    "DramaPageBaiduRule": r'<object id="box">\s*<param value="(?<source>.*?)">',
    "SourceKuaibRule": "", "SourceBaiduRule": "one file holds all",
}


def series_rules(spark, **changes):
    return _rule(spark, SERIES_RULE, {**SERIES, **changes})


def listed(url, title):
    return f'<h3 class="film"><a href={url} lang=zh>{title}</a></h3>'


def series_info(title, area, image="../i/x.jpg", first="动作", second="喜剧"):
    return (f'<a href="/c">{first}</a><img src="{image}"/><h1>《{title}》</h1> 类型: {second} 地区: 大陆 '
            f"<p>某影院 介绍</p>{area}")


def played(*links):
    return "<h2>baidu</h2>" + "".join(
        f"<em data-play='{u}'>{t}</em>" for u, t in links) + "</ul>"


def inline(*links):
    return "<h2>qvod</h2>" + "".join(f"<li q='{u}'>{t}</li>" for u, t in links) + "</ul>"


SOURCE = ("bdhd%3A%2F%2F1%7C11%7CShow%E5%9B%BD%E8%AF%AD02.rmvb%23bdhd://2|22|[www.x.com]Show_01.avi#"
          "bdhd://3|33.mp4#qvod://4|44|Show03\\u4e0a.wmv#bdhd://5|55|Show-01.rm")


def series_pages(spark, source=SOURCE):
    pages = {
        "http://s.example/new/list.html": listed("/s/1.html", "Show...") + listed("/s/2.html", "老片")
                                          + listed("/s/3.html", "...") + '<a rel="next" href="list2.html">',
        "http://s.example/new/list2.html": listed("/s/4.html", "无配") + listed("/s/5.html", "缺页")
                                           + listed("../s/1.html", "Show..."),
        "http://s.example/s/1.html": series_info("Show", played(("/p/1.html", "第1集"), ("/p/2.html", "第2集"))),
        "http://s.example/s/2.html": series_info("老片", inline(("qvod://9|9|x.rmvb", "上"), ("qvod://8|8|y.rmvb", ""))),
        "http://s.example/s/3.html": series_info("x", ""),
        "http://s.example/s/4.html": "<h1>no match</h1>",
        "http://s.example/p/1.html": '<object id="box">\n<param value="http://cdn.example/1.js">',
        "http://s.example/p/2.html": "never opened",
        "http://cdn.example/1.js": source,
    }
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages.items())], PAGE)

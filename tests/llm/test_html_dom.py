import time

import pytest

from rasterlake.llm import html_extract
from rasterlake.llm.html_dom import parse


def _texts(html):
    return [n.text for n in html_extract.page_nodes(parse(html)) if n.tag == "#text"]


@pytest.mark.parametrize(
    "tag", ["<svg class='i'/>", '<SVG class="i" />', "<math/>", "<svg>", "<svg><path d='M0 0'/>", "<svg class=i/>", "<math>", "<template>", "<noscript>", "<object data=x>", "<svg><style/></svg>", "<svg><svg></svg>"]
)
def test_page_goes_on_after(tag):
    rest = "<article><p>One two.</p><svg><path/><text>no</text></svg><p>Three.</p></article>"
    assert _texts(f"<header>{tag}</header>{rest}") == ["One two.", "Three."]
    assert _texts(f"<header>{tag}</header>{rest.replace('<svg><path/><text>no</text></svg>', '')}") == ["One two.", "Three."]


def test_closed_drawings_and_templates_are_left_out():
    assert _texts("<p>a</p><svg><svg><text>b</text></svg><text>c</text></svg><p>d</p>") == ["a", "d"]
    assert _texts("<template><template>b</template>c</template><noscript>e</noscript><p>d</p>") == ["d"]
    assert _texts("<svg><foreignObject><div>b</div></foreignObject><title>t</title></svg><p>d</p>") == ["d"]
    assert _texts("<svg><script>'</svg>'</script><text>b</text><!-- </svg> --></svg ><p>d</p>") == ["d"]
    assert _texts("<svg><path><p>One.</p><p>Two.</p><script>'</svg>'</script></svg><p>d</p>") == ["One.", "Two.", "d"]


def test_capital_end_tags_in_pages_with_letters_that_lengthen():
    assert _texts("<p>İstanbul</p><SCRIPT>no</SCRIPT><STYLE>no</Style ><p>Two.</p><Title>no</TITLE>") == ["İstanbul", "Two."]
    assert _texts("<script>a</scripty></script><p>b</p>") == ["b"]


def test_formulas_and_objects_keep_their_text():
    assert _texts("<p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p>") == ["If x=2 then"]
    assert _texts("<p>a <object data=x><param name=y>b</object> c</p>") == ["a b c"]
    assert _texts("<object><p>b</p></object><p>c</p>") == ["b", "c"]


def test_extracted_article():
    words = "The quick brown fox jumps over the lazy dog, and then it sleeps for a while. " * 4
    page = f"<html><body><header><svg class='i'/><a href='/'>Home</a></header><article><h1>Title of it</h1><p>{words}</p><p>İ {words}</p><SCRIPT>x</SCRIPT><p>{words}</p></article></body></html>"
    text = html_extract.extract([page], html_extract.trained())[0]
    assert text.count(words.strip()) == 3


@pytest.mark.parametrize("piece", ["<svg>", "<svg><p>", "<svg><desc>", "<template>", "<iframe>", "<svg></desc>", "<noscript></svg>", "<textarea>", "<svg><style/>"])
def test_damaged_markup_takes_linear_time(piece):
    began = time.process_time()
    parse(piece * 20_000)
    assert time.process_time() - began < 5


def test_character_data_is_text_in_formulas_alone():
    assert _texts("<p>a<![CDATA[hidden]]>b</p><p>c</p>") == ["ab", "c"]
    assert _texts("<p>a<![CDATA[x > y]]>b</p>") == ["a y]]>b"]
    assert _texts("<p><math><mi><![CDATA[x > y]]></mi></math>b</p><p>a<![CDATA[z]]>") == ["x > yb", "a"]
    assert _texts("<p>a<![CDATA[z") == ["a"]


def test_model_is_kept_in_the_shared_folder(spark, tmp_path, monkeypatch):
    model = html_extract.trained()
    again = html_extract.BoostedTrees.load(model.dump())
    pages = [html_extract.page_maker(70_000_000 + k)[0] for k in range(20)]
    assert html_extract.extract(pages, again) == html_extract.extract(pages, model)
    folder = f"file://{tmp_path}/shared"
    html_extract._kept.cache_clear()
    html_extract._kept(folder)
    assert len(list((tmp_path / "shared").iterdir())) == 1
    html_extract._kept.cache_clear()
    monkeypatch.setattr(html_extract, "trained", lambda: 1 / 0)
    assert html_extract.extract(pages, html_extract._kept(folder)) == html_extract.extract(pages, model)
    html_extract._kept.cache_clear()


def test_repeated_and_very_long_pages(spark):
    body = "<p>" + "Some words of a long article, and more. " * 20_000 + "</p>"
    rows = [(1, f"<html><body><article>{body}</article></body></html>", "u", 1), (2, "<p>One line of text, said twice.</p>", "u", 2), (2, "<p>One line of text, said twice.</p>", "u", 2)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, html string, url string, n_chars int")).collect()
    assert [r.n_chars for r in sorted(got, key=lambda r: r.page_id)][0] == len(" ".join(("Some words of a long article, and more. " * 20_000).split()))
    assert len({r.text for r in got if r.page_id == 2}) == 1 and len(got) == 3


LAYOUTS = {
    "article": '<html><body><header><h1>Daily Post</h1><nav>{nav}</nav></header><main><article><h1>Flood in the valley</h1>{ps}</article></main><aside><h3>Related</h3>{nav}</aside><footer><p>Copyright 2024 Daily Post. All rights reserved.</p></footer></body></html>',
    "divisions": '<html><body><div id="header"><div class="logo"><a href="/">Daily Post</a></div><div class="menu">{nav}</div></div><div id="wrapper"><div class="post-content"><h1>Flood in the valley</h1>{ps}</div><div id="sidebar"><h3>Popular</h3>{nav}</div></div><div id="footer"><p>Copyright 2024 Daily Post.</p><a href="/p">Privacy</a></div></body></html>',
    "table": '<html><body><table><tr><td class="nav">{nav}</td><td class="content"><h1>Flood in the valley</h1>{ps}</td></tr></table><div class="footer">Copyright 2024</div></body></html>',
    "comments": '<html><body><nav>{nav}</nav><div class="entry"><h1>Flood in the valley</h1>{ps}</div><div class="newsletter"><h3>Sign up</h3><p>Get our letter every morning.</p><form><input><button>Go</button></form></div><div id="comments"><h2>2 comments</h2><div class="comment"><b>Ann</b><p>I saw it from my window, it was frightening.</p></div><div class="comment"><b>Bob</b><p>We should build higher walls.</p></div></div><footer>Copyright</footer></body></html>',
    "section": '<html><body><div class="cookie-banner"><p>We use cookies to make this site better. Read our policy.</p><button>Accept</button></div><section class="story"><h1>Flood in the valley</h1>{ps}<div class="ad">Buy boots now, half price!</div></section><section class="related"><h2>More stories</h2>{nav}</section></body></html>',
}


@pytest.mark.parametrize("name", list(LAYOUTS))
def test_layouts_written_by_hand(name):
    said = ["The river rose during the night, and by morning the lower fields were under water.", "Farmers moved their animals to the hills, where the ground was dry, and waited for news from the town.", "Nobody was hurt, the mayor said on Tuesday, but the damage to roads and bridges will take months to repair."]
    nav = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul>'
    page = LAYOUTS[name].format(nav=nav, ps="".join(f"<p>{p}</p>" for p in said))
    assert html_extract.extract([page], html_extract.trained()) == ["\n\n".join(["Flood in the valley", *said])]

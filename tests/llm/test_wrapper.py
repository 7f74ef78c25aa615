from grovekit.llm import markup, wrapper


def page(title, body, items):
    return f"<html><body><div class=head><a>Home</a><b>The Daily Mill</b></div><h1>{title}</h1><p>{body}</p><ul>{''.join(f'<li>{x}</li>' for x in items)}</ul><div>All rights kept<br></body></html>"


def test_template_and_content_of_a_host(spark):
    rows = [(i, "a.example", page(f"Title {i}", f"Body {i}", [f"x{i}{k}" for k in range(i % 4)])) for i in range(12)] + [(50, "b.example", "<p>alone"), (51, None, "<p>no host"), (52, "b.example", None), (52, "a.example", "plain")]
    df = spark.createDataFrame(rows, "id long, host string, html string").withColumn("text", df_clash())
    w = wrapper.induce(df, "host", "html")
    got = {(r.id, r.content) for r in wrapper.content(df, "id", "host", "html", w).collect()}
    assert got == {(i, "\n".join([f"Title {i}", f"Body {i}", *(f"x{i}{k}" for k in range(i % 4))])) for i in range(12)} | {(50, "alone"), (51, "no host"), (52, ""), (52, "plain")}
    assert wrapper.content(df.limit(0), "id", "host", "html", wrapper.induce(df.limit(0), "host", "html")).count() == 0


def df_clash():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_simple_tree_matching():
    a, b = wrapper.tree("<div><p>1</p><p>2</p><b>3</b></div>"), wrapper.tree("<div><p>x</p><i>y</i><b>z</b></div>")
    got = {(n.tag, path) for n, path in wrapper.align(a, b)}
    assert got == {("", ""), ("div", "/0"), ("p", "/0/0"), ("b", "/0/2")}
    deep = wrapper.tree("<div>" * 5000 + "x")
    assert wrapper.size(deep) <= wrapper.DEPTH + 1


def test_deep_markup_and_long_formulas():
    deep = "{\\it " * 60 + "core" + "}" * 60
    assert "core" in markup.Reading(deep).clean
    r = markup.Reading("as $" + "x_1 + " * 200 + "x_2$ shows")
    assert r.kinds == {"math": 1}

"""Call edges C1–C11, matrix J1–J3/F1–F5: lexical grammar, goldens, plans."""

from pyspark.sql import functions as F

from svcseam.operators import calls as C
from svcseam.operators import matrix as X
from svcseam.operators import metrics as A

JAVA = '''package org.demo.web;

import java.util.List;

// owner.find() in a comment is ignored
public class OwnerController {
    @Autowired
    private OwnerRepository unused;
    @Autowired private OwnerRepository owners;
    void a() {
        owners.findAll("x.y()");
        super.init();
        run();
        b.go();
        System.out.println(owners.count());
        /* block
           comment.call() */
        this.helper(); java.util.List<String> l = new java.util.ArrayList<>(); // qualified constructor
    }
    @org.junit.Test(timeout = 1)
    class Inner {
        void c() { owners.save(1); }
    }
    void d() { owners.delete(2); }
}
'''


def _src(spark, files):
    return spark.createDataFrame([("p", path, text) for path, text in files],
                                 "project_id string, path string, content string")


def test_lexical_call_edges(spark):
    parsed = C.parse_sources(_src(spark, [("p/OwnerController.java", JAVA), ("p/Empty.java", "enum E { A }")]))
    e = C.call_edges(parsed).orderBy("line_number", "call_idx").collect()
    got = [(r.from_class, r.to_class, r.method_name, r.call_type, r.line_number) for r in e]
    assert got == [
        ("OwnerController", "OwnerRepository", "unused", "autowired", 7),   # annotation on its own line
        ("OwnerController", "OwnerRepository", "owners", "autowired", 9),
        ("OwnerController", "owners", "findAll", "method_call", 11),
        ("OwnerController", "super", "init", "method_call", 12),   # C2: super passes; run(), b.go() dropped
        ("OwnerController", "System.out", "println", "method_call", 15),
        ("OwnerController", "owners", "count", "method_call", 15),
        ("Inner", "owners", "save", "method_call", 22),
        ("Inner", "owners", "delete", "method_call", 24),          # owner class is not restored
    ]
    assert {r.from_package for r in e} == {"org.demo.web"}
    st = C.file_status(parsed).collect()[0]
    assert (st.total_files, st.parsed_files, st.error_files) == (2, 2, 0)  # an enum file is parsed


def _found(spark, text):
    e = C.call_edges(C.parse_sources(_src(spark, [("A.java", text)]))).orderBy("call_idx").collect()
    return [(r.from_class, r.to_class, r.method_name, r.line_number) for r in e]


def test_calls_over_lines_nesting_and_constructors(spark):
    text = """class A {
  void f() {
    one.two(three(four(5))).six();
    builder.start()
        .next("x(")
        .build();
    new Foo().bar();
    repo.a(new Foo(1)).b();
    java.util.List<String> l = new java.util.ArrayList<>(svc.all().size());
    xs[0].go(); ((Foo) yy).run(); List.<String>of(1).size();
  }
}
"""
    assert _found(spark, text) == [
        ("A", "one.two(three(four(5)))", "six", 3), ("A", "one", "two", 3),  # the outer link first
        ("A", 'builder.start().next("x(")', "build", 4), ("A", "builder.start()", "next", 4), ("A", "builder", "start", 4),
        ("A", "new Foo()", "bar", 7),
        ("A", "repo.a(new Foo(1))", "b", 8), ("A", "repo", "a", 8),
        ("A", "svc.all()", "size", 9), ("A", "svc", "all", 9),
        ("A", "xs[0]", "go", 10), ("A", "((Foo)yy)", "run", 10), ("A", "List.<String>of(1)", "size", 10), ("A", "List", "of", 10),
    ]


def test_calls_on_literals_and_after_bodies(spark):
    text = '''class A {
  void f(String m) {
    "GET".equals(m); "a  . b".split(" ,  ").length; "a".concat(b).trim(); "".isEmpty();
    """
      x.y() (
      """.formatted(m);
    new X() { void g() { aa.bb(); } }.run();
    new int[]{1}.clone(); new int[][] {{1}, {2}}.clone();
    for (Y y : new Ys()) { y2.go(); } if (m == "q") { z2.go(); }
  }
}
'''
    assert _found(spark, text) == [
        ("A", '"GET"', "equals", 3), ("A", '"a  . b"', "split", 3), ("A", '"a".concat(b)', "trim", 3), ("A", '"a"', "concat", 3),
        ("A", '""', "isEmpty", 3),
        ("A", '"""\n      x.y() (\n      """', "formatted", 4),
        ("A", "new X(){ void g(){ aa.bb(); } }", "run", 7), ("A", "aa", "bb", 7),
        ("A", "new int[]{1}", "clone", 8), ("A", "new int[][] {{1}, {2}}", "clone", 8),
        ("A", "y2", "go", 9), ("A", "z2", "go", 9),
    ]


def test_visits_go_from_the_outside(spark):
    """A call, the calls in its arguments, then those in its scope, at any nesting."""
    text = """class A {
  void f() {
    aa.bb(cc.dd(), ee.ff(gg.hh())).ii(jj.kk(() -> { ll.mm(); nn.oo(); })).pp();
    outer.new Inner(qq.rr()).go(); (ss.tt()).uu();
  }
}
"""
    assert [(s, m) for _, s, m, _ in _found(spark, text)] == [
        ("aa.bb(cc.dd(), ee.ff(gg.hh())).ii(jj.kk(()-> { ll.mm(); nn.oo(); }))", "pp"),
        ("aa.bb(cc.dd(), ee.ff(gg.hh()))", "ii"), ("jj", "kk"), ("ll", "mm"), ("nn", "oo"),
        ("aa", "bb"), ("cc", "dd"), ("ee", "ff"), ("gg", "hh"),
        ("outer.new Inner(qq.rr())", "go"), ("qq", "rr"), ("(ss.tt())", "uu"), ("ss", "tt")]


def test_written_annotation_names_and_packages(spark):
    field = "class A {{ {} private Repo repo; }}"
    for a, n in [("@Inject", 1), ("@Autowired(required = false) @Lazy", 1), ("@Lazy\n@Autowired", 1), ("@javax.inject.Inject", 0), ("@Injected", 0), ("@Lazy", 0)]:
        assert len(_found(spark, field.format(a))) == n, a
    heads = {"package a.b ;\nclass A {": "a.b", "/** {@link X} package no; */ // package not;\n@Ann(\"x\") package yes;class A {": "yes",
             "class A { String s = \"\"\"\npackage no;\n\"\"\"; void f() {}": "default", "// package no;\nimport x.y;\nclass A {": "default"}
    for head, want in heads.items():
        e = C.call_edges(C.parse_sources(_src(spark, [("A.java", head + " void g() { aa.bb(); } }")]))).collect()
        assert [r.from_package for r in e] == [want], head


def test_open_comments_and_quotes_are_error_files(spark):
    bad = ["class A { void f() { a1.b(); } } /* open", 'class A { String s = "open; void f() { a1.b(); } }', "class A { char c = '; void f() { a1.b(); } }",
           "class A { void f() { a1.b(; }", None]
    good = ["class A { /* closed */ void f() { a1.b(\"/* no comment\"); } }", "", "class A { int x = 4 / 2; }"]
    parsed = C.parse_sources(_src(spark, [(f"{i}.java", t) for i, t in enumerate(bad + good)]))
    st = C.file_status(parsed).collect()[0]
    assert (st.total_files, st.parsed_files, st.error_files) == (8, 3, 5)
    assert [r.path for r in C.call_edges(parsed).collect()] == ["5.java"]


def test_adjacency_ranks_targets_of_a_hub(spark):
    edges = spark.range(3000).select(F.lit("p").alias("project_id"), F.lit("Hub").alias("from_class"), F.concat(F.lit("t"), F.col("id") % 1000).alias("to_class"),
                                     F.format_string("f%d.java", F.col("id") % 3).alias("path"), F.lit(1).alias("line_number"), F.col("id").cast("int").alias("call_idx"))
    got = {r["rank"]: r for r in C.adjacency(edges).collect()}
    first = {}
    for f in range(3):
        for i in range(f, 3000, 3):
            first.setdefault(f"t{i % 1000}", len(first) + 1)
    assert {r.to_class: k for k, r in got.items()} == first and {r.n_targets for r in got.values()} == {1000} and {r.n_calls for r in got.values()} == {3}


def test_spread_annotations_enum_and_annotation_files(spark):
    text = """/* package no; */
package yes;
@interface Marker { String v() default "a.b()"; }
enum Kind {
  ONE;
  @Autowired
  @Qualifier("main")
  @Lazy

  // far from the annotation
  private Map<String, Repo> repos;
  void f() { repos.get("x"); }
}
"""
    assert _found(spark, text) == [("Unknown", "Map<String, Repo>", "repos", 6), ("Unknown", "repos", "get", 12)]
    e = C.call_edges(C.parse_sources(_src(spark, [("A.java", text)]))).collect()
    assert {r.from_package for r in e} == {"yes"} and {r.call_type for r in e} == {"autowired", "method_call"}


def test_long_line_and_broken_file(spark):
    deep = "class A { void f() { " + "aa.b(" * 8000 + "1" + ")" * 8000 + "; cc.d(" + "x + " * 12000 + "1).ee(); } }"
    assert len(_found(spark, deep)) == 8002
    parsed = C.parse_sources(_src(spark, [("A.java", "class A { void f() { a.b( } }"), ("B.java", None)]))
    assert C.call_edges(parsed).count() == 0
    st = C.file_status(parsed).collect()[0]
    assert (st.total_files, st.parsed_files, st.error_files) == (2, 0, 2)


def _edges(spark, rows):
    return spark.createDataFrame(
        [("p", "f.java", a, "pkg", b, "m", t, i, 0) for i, (a, b, t) in enumerate(rows)],
        "project_id string, path string, from_class string, from_package string, to_class string, "
        "method_name string, call_type string, line_number int, call_idx int")


def test_call_metrics_compat_and_fixed(spark):
    e = _edges(spark, [("A", "b", "method_call"), ("A", "B", "autowired"), ("A", "b", "method_call"),
                       ("B", "a", "method_call")])
    m = {r.class_name: r for r in A.call_metrics(e).collect()}
    assert (m["A"].calls_out, m["A"].calls_in, m["A"].deps_unique, m["A"].has_autowired) == (3, 0, 0, 1)
    assert (m["B"].calls_out, m["B"].calls_in) == (1, 1)
    f = {r.class_name: r for r in A.call_metrics(e, fixed=True).collect()}
    assert (f["A"].calls_in, f["A"].deps_unique) == (1, 2) and f["B"].calls_in == 3
    adj = {}
    for r in C.adjacency(e).orderBy("from_class", "rank").collect():
        adj.setdefault(r.from_class, []).append(r.to_class)
    assert adj == {"A": ["b", "B"], "B": ["a"]}
    assert sum(r.calls_out for r in m.values()) == e.count()


GOLDEN = {  # recorded golden: class → related table
    "Owner": "owners", "PetController": "pets", "PetValidator": "pets", "Vet": "vets", "Visit": "visits",
    "PetClinicApplication": None, "PetClinicRuntimeHints": None, "VetController": "vets",
    "VisitController": "visits", "OwnerController": "owners", "Pet": "pets", "PetTypeFormatter": None,
    "CacheConfiguration": None, "WebConfiguration": None,
}
TABLES = ["vets", "specialties", "vet_specialties", "types", "owners", "pets", "visits"]


def _classes(spark, names):
    return spark.createDataFrame([("p", n) for n in names], "project_id string, class_name string")


def _tables(spark, names):
    return spark.createDataFrame([("p", t) for t in names], "project_id string, table_name string")


def test_related_table_golden(spark):
    r = {x.class_name: x.related_table for x in X.related_table(_classes(spark, GOLDEN), _tables(spark, TABLES)).collect()}
    assert r == GOLDEN


def test_related_table_empty_stem_and_ties(spark):
    r = {x.class_name: x.related_table for x in
         X.related_table(_classes(spark, ["Controller", "Ab"]), _tables(spark, ["abc", "xab", "zz", "ab2"])).collect()}
    assert r == {"Controller": "zz", "Ab": "ab2"}  # shortest, then alphabetical


def test_related_table_is_equi_join(spark):
    df = X.related_table(_classes(spark, GOLDEN), _tables(spark, TABLES))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_classification_golden(spark):
    m = X.classify(_classes(spark, GOLDEN)).collect()
    d = {r.class_name: (r.domain, r.stereotype, r.stereotype_rank) for r in m}
    assert d["PetClinicApplication"] == ("owner-pet-visit", "Application", 5)
    assert d["VetController"] == ("veterinaire", "Controleur", 1)
    assert d["CacheConfiguration"] == ("systeme", "Configuration", 5)
    assert d["PetTypeFormatter"][1] == "Utilitaire" and d["PetValidator"][1] == "Validateur"
    assert d["Owner"] == ("owner-pet-visit", "Entite", 4)


def test_matrix_from_fixture_consistent(spark, sf_small):
    from svcseam.plans.extraction import Extraction
    x = Extraction.from_fixtures(spark, sf_small)
    m = x.matrix
    assert m.count() == x.classes.count()
    tot = m.agg(F.sum("calls_out")).collect()[0][0]
    assert tot == x.edges.count()


def test_chained_calls(spark):
    src = ("package p;\nclass A {\n  void f() {\n    repo.findAll().stream().map(x -> x.getName()).count();\n"
           "    foo().bar(\"a.b()\");\n    this.repo.find(1, g(2)).x();\n  }\n}\n")
    e = C.call_edges(C.parse_sources(_src(spark, [("A.java", src)]))).orderBy("line_number", "call_idx").collect()
    assert [(r.line_number, r.to_class, r.method_name) for r in e] == [
        (4, "repo.findAll().stream().map(x -> x.getName())", "count"),
        (4, "repo.findAll().stream()", "map"), (4, "repo.findAll()", "stream"), (4, "repo", "findAll"),
        (5, "foo()", "bar"),
        (6, "this.repo.find(1, g(2))", "x"), (6, "this.repo", "find"),
    ]


def test_long_operand_runs_are_one_token(spark):
    """operands between operators take no step of the scan each; sites, fields and lines stay."""
    from svcseam.functions import javalex as JL
    text = "class A { @Autowired Map<String, B, C> m, n; void f() { int k = 1 + " + "x + " * 5000 + "aa.bb(y + z, new D(1 + 2 * w)) / 2; cc.dd(); } }"
    assert max(map(len, JL._TOKEN.findall(text))) > 10_000
    assert [(s[0], s[1], s[2]) for s in JL.scan_java(text)[1]] == [("type", "A", None), ("field", "m", "Map<String, B, C>"), ("call", "bb", "aa"), ("call", "dd", "cc")]
    assert JL.scan_java("class A { void f() { new + a + B r; @ , b + c; } }")[0]


def test_class_list_moves_no_target_text(spark):
    """the exchange of the sites holds only what the consumer reads."""
    edges = C.call_edges(C.parse_sources(_src(spark, [("A.java", JAVA)])))
    df = C.class_list(edges)
    nodes = df._jdf.queryExecution().optimizedPlan()
    while not nodes.nodeName().startswith("Window"):
        nodes = nodes.children().apply(0)
    moved = nodes.children().apply(0).output()
    assert {moved.apply(i).name() for i in range(moved.size())} == {"project_id", "path", "at", "type", "call_type"}
    assert {r.class_name for r in df.collect()} == {"OwnerController", "Inner"}


def test_positions_write_only_what_is_kept(spark):
    """columns that only order are neither written nor joined; null groups are placed too."""
    from svcseam.operators.ranks import positions
    rows = spark.createDataFrame([(None, "x", i, "long text") for i in range(5)] + [("g", None, i, "t") for i in range(3)], "a string, b string, o int, text string")
    df = positions(rows.repartition(4), ["a", "b"], ["o"], size="n", keep=["a", "b"])
    assert df.columns == ["a", "b", "pos", "n"] and "text" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.a or "", r.b or "", r.pos, r.n) for r in df.collect()) == [("", "x", i, 5) for i in range(5)] + [("g", "", i, 3) for i in range(3)]


def test_names_and_empty_brackets_are_one_token(spark):
    """dotted names, empty brackets and comments take no step of the scan each; what is found stays."""
    from svcseam.functions import javalex as JL
    assert [t.strip() for t in JL._TOKEN.findall("a.b . c.dd( ) .ee(new X().f, x1)")] == ["a.b . c.dd", "( )", ".ee", "(", "new", "X", "()", ".f", ",", "x1", ")"]
    text = """class A extends b.C {
  @Lazy() @javax.inject.Named("n") @Inject b . Repo<x.Y> [] repo = f( );
  void g() {
    aa./* c.d() */bb( ) // e.f()
      .cc().dd; outer.new In().go( ); List.<String> of( ).size(); return this.x . yy(); import.zz.ww();
    new int[]{1}.clone(); new p.X<>( ) { void h() { (ii).jj(); } }.kk();
  }
}
"""
    assert JL.scan_java(text)[0]
    assert _found(spark, text) == [
        ("A", "b.Repo<x.Y> []", "repo", 2),
        ("A", "aa./* c.d()*/bb()", "cc", 4), ("A", "aa", "bb", 4),
        ("A", "outer.new In()", "go", 5), ("A", "List.<String> of()", "size", 5), ("A", "List", "of", 5), ("A", "this.x", "yy", 5), ("A", "zz", "ww", 5),
        ("A", "new int[]{1}", "clone", 6), ("A", "new p.X<>(){ void h(){(ii).jj(); } }", "kk", 6), ("A", "(ii)", "jj", 6)]


def test_lines_of_many_sites_and_of_few():
    """lines are counted from the beginning for few sites, looked up for many; visits of plain calls keep their order."""
    from svcseam.functions import javalex as JL
    for n in (2, 2000):
        text = "class A { void f() {\n" + "".join(f"  aa.b{i}();\n" for i in range(n)) + "} }"
        sites = JL.scan_java(text)[1]
        assert JL.visit_order(sites) == [0, *range(n)] and JL.visit_order([]) == []
        assert [text.count("\n", 0, s[4]) + 1 for s in sites] == [1, *range(2, n + 2)]
    found = JL.scan_java("class A { void f() { aa.bb(cc.dd()); ee.ff().gg(); } }")[1]
    assert JL.visit_order(found) == [0, 0, 1, 3, 2]


def test_call_metrics_take_one_aggregate(spark):
    """An edge is counted for its caller and its callee in one pass; missing names have no callers."""
    rows = [("p", "A", "B", "autowired"), ("p", "A", "C", None), ("p", "B", "A", "method_call"), ("p", "B", "A", "method_call"), ("p", None, "A", "x"), ("p", "B", None, "x"),
            (None, "A", "A", "x"), ("q", "Z", "Z", None)]
    df = A.call_metrics(spark.createDataFrame(rows, "project_id string, from_class string, to_class string, call_type string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "Join" not in plan
    got = {(r.project_id, r.class_name): (r.calls_out, r.calls_in, r.deps_unique, r.has_autowired) for r in df.collect()}
    assert got == {("p", "A"): (2, 3, 0, 1), ("p", "B"): (3, 1, 0, 0), ("p", None): (1, 0, 0, 0), (None, "A"): (1, 0, 0, 0), ("q", "Z"): (1, 1, 0, None)}


def test_matrix_writes_no_edges(spark, sf_small):
    """The edges are read in one pass and not written; the class list is in the call metrics."""
    from svcseam.plans.extraction import Extraction
    x = Extraction.from_fixtures(spark, sf_small)
    m = x.matrix
    assert "edges" not in vars(x) and "classes" not in vars(x)
    want = C.class_list(x.edges)
    assert x.classes.exceptAll(want).count() == 0 == want.exceptAll(x.classes).count()
    joined = X.feature_matrix(want, A.call_metrics(x.edges), x.tables, x.table_metrics)  # J1 as a join
    assert m.exceptAll(joined).count() == 0 == joined.exceptAll(m).count()


def test_table_metrics_meet_stems(spark):
    """No row of a class is moved to its table: the metrics join the stems."""
    metrics = spark.createDataFrame([("p", "pet", 3, 1, 0, 1, 7), ("p", "pets", 2, 0, 1, 0, 0)], "project_id string, table_name string, db_columns long, db_fk_out long, db_fk_in long, db_relations long, log_frequency long")
    calls = spark.createDataFrame([("p", "PetService", 4, 2, 0, 1), ("p", None, 1, 0, 0, 0), ("p", "Xyz", 1, 0, 0, 0)], "project_id string, class_name string, calls_out long, calls_in long, deps_unique long, has_autowired int")
    df = X.feature_matrix(calls, None, _tables(spark, ["pet", "pets"]), metrics)
    p = df._jdf.queryExecution().optimizedPlan().toString()
    top = p[:p.index("Join")] + p[p.index("Join"):].split("\n")[0]
    assert "stem" in top.split("Join")[1]
    got = {r.class_name: (r.related_table, r.calls_out, r.db_columns, r.log_frequency) for r in df.collect()}
    assert got == {"PetService": ("pet", 4, 3, 7), None: (None, 0, 0, 0), "Xyz": (None, 1, 0, 0)}

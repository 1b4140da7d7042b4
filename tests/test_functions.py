import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.functions import paths as P
from spindrift.functions import text as X
from spindrift.functions.chunks import estimate, is_good_end, line_chunks, split_lines, unit_chunks
from spindrift.functions.units import extract_units
from spindrift.sources.files import gitignore_rules


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"), [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb", ["a", "b"]), ("\n\n", ["", ""]), ("a\n\nb\n", ["a", "", "b"])]
)
def test_lines(spark, text, want):
    assert one(spark, X.lines(F.lit(text))) == want == split_lines(text)


def test_scalars(spark):
    assert one(spark, X.file_header(F.lit("\n".join(map(str, range(60)))))) == "\n".join(map(str, range(50)))
    assert one(spark, X.token_estimate(F.lit("éé1"))) == 1 and one(spark, X.billed_tokens(F.lit("éé1"))) == 2
    assert one(spark, X.tokens(F.lit("Hello, hello_world É2"))) == ["hello", "hello", "world", "é2"]
    assert one(spark, X.preview(F.lit("1\n2\n3\n4\n5\n6"))) == "   1\n   2\n   3\n   4\n   5\n   ..."
    assert one(spark, X.sanitize_name(F.lit("My Project!_1-ä"))) == "my-project-_1-ä"
    assert one(spark, X.project_id(F.lit("/home/x/My App/"))).startswith("my-app-")
    assert [one(spark, X.human_bytes(F.lit(b))) for b in (0, 1023, 1024, 1536, 1048576, 1 << 30)] == ["0 B", "1023 B", "1.00 KB", "1.50 KB", "1.00 MB", "1.00 GB"]
    assert one(spark, X.truncate_end(F.lit("abcdefgh"), 6)) == "abc..." and one(spark, X.truncate_start(F.lit("abcdefgh"), 6)) == "...fgh"
    assert one(spark, X.escape_query(F.lit("a+b (c) \"d\""))) == "a b  c   d "
    assert [one(spark, X.edit_distance(F.lit(a), F.lit(b))) for a, b in (("", ""), ("abc", ""), ("kitten", "sitting"), ("é", "e"), ("hello", "world"))] == [0, 3, 3, 1, 4]


@pytest.mark.parametrize(
    ("glob", "path", "want"),
    [
        ("*.rs", "src/a.rs", True), ("src/*.rs", "src/b/a.rs", True), ("src/**/*.rs", "src/a.rs", True), ("src/**/*.rs", "lib/a.rs", False),
        ("a?c", "abc", True), ("[!a]b", "ab", False), ("[a-c]b", "bb", True), ("a.b", "axb", False), ("x[0-9].py", "x7.py", True),
    ],
)
def test_globs(spark, glob, path, want):
    assert one(spark, P.matches_glob(F.lit(path), glob)) is want


def test_bad_glob():
    with pytest.raises(ValueError):
        P.glob_regex("[a")


def test_paths(spark):
    assert [one(spark, P.extension(F.lit(p))) for p in ("a/b.rs", "a.b/c", "x.tar.gz", ".hidden", "a/.x.py")] == ["rs", None, "gz", None, "py"]
    assert one(spark, P.is_ignored(F.lit("src/builder.rs"))) and not one(spark, P.is_ignored(F.lit("src/builder.rs"), mode="component"))
    assert one(spark, P.detect_language(F.lit("a.hxx"))) == "hxx" and one(spark, P.detect_language(F.lit("a.hxx"), "unit")) is None
    assert one(spark, P.detect_language(F.lit("a.h"), "parser")) == "c" and one(spark, P.detect_language(F.lit("Makefile"))) is None


def test_gitignore(spark):
    rules = gitignore_rules("# c\n*.log\n/build/\n!keep.log\ndocs/*.txt\n**/tmp\n")
    paths = ["a.log", "x/b.log", "keep.log", "build/a", "x/build/a", "docs/a.txt", "docs/x/a.txt", "q/tmp/z", "src/a.rs"]
    from spindrift.sources.files import without_ignored

    left = [r.file_path for r in without_ignored(spark.createDataFrame([(p,) for p in paths], "file_path string"), rules).collect()]
    assert left == ["keep.log", "x/build/a", "docs/x/a.txt", "src/a.rs"]


@given(st.lists(st.sampled_from(["", "}", "fn a() {", "x = 1", "  ", "a" * 40, "é" * 9]), max_size=80), st.integers(1, 40), st.integers(0, 12))
def test_line_chunks_keep_the_budget(rows, tokens, overlap):
    """Every piece ends where its budget is full or at a good end close before; pieces overlap a little and leave no gap."""
    text = "\n".join(rows)
    got = line_chunks(text, tokens, overlap)
    lines = split_lines(text)
    weight = [len(r.encode()) + 1 for r in lines]
    good = {i for i, r in enumerate(lines) if is_good_end(r, lines[i + 1] if i + 1 < len(lines) else None)}
    for p in got:
        first, last = p.start_line - 1, p.end_line - 1
        assert p.content == "\n".join(lines[first : last + 1]) and p.content.strip()
        full = next((i for i in range(first, len(lines)) if sum(weight[first : i + 1]) >= 4 * tokens), None)
        close = [g for g in good if full is not None and first < g <= full and g >= full - full // 5]
        assert last == (len(lines) - 1 if full is None else max(close, default=full))
    for p, q in zip(got, got[1:], strict=False):
        shared = range(q.start_line, p.end_line + 1)
        assert p.start_line < q.start_line and len(shared) <= 5
        if len(shared) > 1:  # one line less would not hold the overlap
            assert sum(weight[i - 1] for i in shared[1:]) < 4 * overlap
    covered = {i for p in got for i in range(p.start_line, p.end_line + 1)}
    assert all(i in covered for i, r in enumerate(lines, 1) if r.strip())


def test_line_chunks_of_blank_stretches_end():
    assert [(p.start_line, p.end_line) for p in line_chunks("a\n" + "\n" * 50 + "b", 1, 12)][-1][1] == 52
    assert line_chunks("\n" * 40, 1, 5) == []


def test_line_chunk_edges():
    assert line_chunks("", 50) == [] and line_chunks(" \n\t\n", 50) == []
    assert [(p.start_line, p.end_line) for p in line_chunks("a\nb\nc")] == [(1, 3)]
    assert len(line_chunks("\n\n".join(f"fn f{i}() {{}}" for i in range(100)), 50)) > 3


RUST = """use x;
// fn no() {}
pub struct A { x: i32 }
impl A {
    pub fn new(x: i32) -> Self { let s = "}"; A { x } }
    #[test]
    fn checks() { assert!(true); }
}
trait T { fn f(&self); fn g(&self) {} }
const MAX: usize = 3;
type R = Result<()>;
macro_rules! foo { () => {} }
mod m { fn inner() {} }
enum E { A, B }
"""


def test_rust_units():
    got = [(u.kind, u.name, u.parent) for u in extract_units(RUST, "rust")]
    assert got == [
        ("struct", "A", None), ("impl", "A", None), ("method", "new", "A"), ("test", "checks", "A"), ("trait", "T", None), ("function", "g", None),
        ("constant", "MAX", None), ("type_alias", "R", None), ("macro", "foo", None), ("module", "m", None), ("function", "inner", None), ("enum", "E", None),
    ]
    new = next(u for u in extract_units(RUST, "rust") if u.name == "new")
    assert (new.signature, new.start_line, new.end_line, new.visibility) == ("pub fn new (x: i32) -> Self", 5, 5, "public")


@pytest.mark.parametrize(
    ("language", "source", "want"),
    [
        ("python", "class A:\n    def f(self): pass\n    @p\n    def g(self): pass\n@d\nclass B:\n    def h(self): pass\ndef test_x(a: int) -> str: pass\n",
         [("class", "A"), ("method", "f"), ("method", "g"), ("class", "B"), ("test", "test_x")]),
        ("go", "type S struct { a int }\ntype I interface { F() }\nfunc (s *S) Do() error { return nil }\nfunc TestA(t *T) {}\nfunc main() {}\nconst P = 3.14159265358\nconst q = 1\n",
         [("struct", "S"), ("interface", "I"), ("method", "Do"), ("test", "TestA"), ("function", "main"), ("constant", "P")]),
        ("java", "public class A {\n  static final int X = 1;\n  A() { }\n  @Test\n  void runs() { if (x) { } }\n  int get() { return 1; }\n  enum E { P }\n}\ninterface I { void f(); }\n",
         [("class", "A"), ("constant", "X"), ("method", "A"), ("test", "runs"), ("method", "get"), ("enum", "E"), ("interface", "I"), ("method", "f")]),
        ("typescript", "export class A { m() {} }\nclass B { async run(a: string): Promise<void> { if (a) {} } }\ninterface I { a: string }\ntype T = string;\nenum E { A }\nconst f = (a) => { return a; };\nfunction testIt() {}\n",
         [("class", "A"), ("class", "B"), ("method", "run"), ("interface", "I"), ("type_alias", "T"), ("enum", "E"), ("function", "f"), ("test", "testIt")]),
        ("c", "typedef struct { int a; } P;\nstruct S { int x; };\nenum E { A };\nstatic int *add(int a) { if (a) { return 0; } return 1; }\n",
         [("type_alias", "P"), ("struct", "S"), ("enum", "E"), ("function", "add")]),
        ("cpp", "namespace n {\nclass A { public: int f() const { return 1; } };\ntemplate <typename T> T mx(T a) { return a; }\nusing V = int;\n}\n",
         [("module", "n"), ("class", "A"), ("method", "f"), ("function", "mx"), ("type_alias", "V")]),
        ("python", "def broken(:\n", []), ("cobol", "x", []),
    ],
)
def test_units(language, source, want):
    assert [(u.kind, u.name) for u in extract_units(source, language)] == want


def test_unit_chunks():
    small = "def a(): pass\n\n\ndef b(): pass\n"
    merged = unit_chunks(small, "python")
    assert [(p.origin, p.unit.name, p.start_line, p.end_line) for p in merged] == [("merged", "a", 1, 4)]
    big = "def big():\n" + "".join(f"    x{i} = {i}\n" for i in range(400)) + "\ndef next_one():\n" + "    y = 1\n" * 40
    parts = unit_chunks(big, "python", most=200)
    assert parts[0].unit.name == "big" and parts[1].unit is None and parts[-1].unit.name == "next_one"
    assert all(estimate(p.content) <= 230 for p in parts)
    assert [p.origin for p in unit_chunks("no units here", "python")] == ["line"]
    assert unit_chunks("", "python") == []


def test_extractors_never_fail():
    rng = random.Random(1)
    for language in ("rust", "go", "java", "typescript", "c", "cpp", "python"):
        for _ in range(60):
            source = "".join(rng.choice(["fn f", "class A", "{", "}", "(", ")", ";", "\n", '"', "'", "/*", "*/", "//", " ", "impl ", "é", "func ", "=>", "const "]) for _ in range(60))
            for u in extract_units(source, language):
                assert 1 <= u.start_line <= u.end_line <= source.count("\n") + 1

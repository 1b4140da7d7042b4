"""Source texts made from rows, and the units that a reader should find in them: what the registered chunking queries run over.

``{k}`` and ``{s}`` stand for a row's key and size. Units are (kind, name, first line, last line, signature, parent, visibility, doc).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLES = [
    ("rust", "rs", """\
/// Adds {s}.
pub fn add_{k}(a: i32) -> i32 {
    a + {s}
}

struct Part{k} {
    size: i32,
}

impl Part{k} {
    fn size(&self) -> i32 {
        self.size
    }
}
""", [
        ("function", "add_{k}", 2, 4, "pub fn add_{k} (a: i32) -> i32", None, "public", "Adds {s}."),
        ("struct", "Part{k}", 6, 8, None, None, "private", None),
        ("impl", "Part{k}", 10, 14, None, None, "private", None),
        ("method", "size", 11, 13, "fn size (&self) -> i32", "Part{k}", "private", None),
    ]),
    ("python", "py", """\
def add_{k}(a, b={s}):
    \"\"\"Adds two.\"\"\"
    return a + b


class Part{k}:
    def size(self) -> int:
        return {s}

    def _hidden(self):
        return "{"


async def test_{k}():
    pass
""", [
        ("function", "add_{k}", 1, 3, "def add_{k} (a, b={s})", None, "public", "Adds two."),
        ("class", "Part{k}", 6, 11, None, None, "public", None),
        ("method", "size", 7, 8, "def size (self) -> int", "Part{k}", "public", None),
        ("method", "_hidden", 10, 11, "def _hidden (self)", "Part{k}", "private", None),
        ("test", "test_{k}", 14, 15, "async def test_{k} ()", None, "public", None),
    ]),
    ("go", "go", """\
package parts

// Part{k} has a size.
type Part{k} struct {
	Size int
}

func (p *Part{k}) Get() int {
	return p.Size + {s} // not a }
}

func add{k}(a int) int {
	return a + {s}
}

type Sized{k} interface {
	Get() int
}
""", [
        ("struct", "Part{k}", 4, 6, None, None, "public", "Part{k} has a size."),
        ("method", "Get", 8, 10, "func (p *Part{k}) Get () int", "Part{k}", "public", None),
        ("function", "add{k}", 12, 14, "func add{k} (a int) int", None, "private", None),
        ("interface", "Sized{k}", 16, 18, None, None, "public", None),
    ]),
    ("java", "java", """\
/**
 * A part of size {s}.
 */
public class Part{k} {
    private static final int SIZE = {s};

    public int size() {
        return SIZE;
    }

    @Test
    void checksSize() {
        assert size() == {s};
    }
}

interface Sized{k} {
    int size();
}
""", [
        ("class", "Part{k}", 4, 15, None, None, "public", "A part of size {s}."),
        ("constant", "SIZE", 5, 5, None, "Part{k}", "private", None),
        ("method", "size", 7, 9, "public int size ()", "Part{k}", "public", None),
        ("test", "checksSize", 11, 14, "@Test void checksSize ()", "Part{k}", "package", None),
        ("interface", "Sized{k}", 17, 19, None, None, "package", None),
        ("method", "size", 18, 18, "int size ()", "Sized{k}", "package", None),
    ]),
    ("typescript", "ts", """\
export interface Sized{k} {
  size: number;
}

class Part{k} {
  private size: number = {s};

  public get(): number {
    return this.size;
  }
}

export const add{k} = (a: number): number => {
  return a + {s};
};

type Name{k} = string;
""", [
        ("interface", "Sized{k}", 1, 3, None, None, "public", None),
        ("class", "Part{k}", 5, 11, None, None, None, None),
        ("method", "get", 8, 10, "public get (): number", "Part{k}", "public", None),
        ("function", "add{k}", 13, 15, "export const add{k} = (a: number): number", None, "public", None),
        ("type_alias", "Name{k}", 17, 17, None, None, None, None),
    ]),
    ("c", "c", """\
#include <stdio.h>

struct part_{k} {
    int size;
};

enum color_{k} { RED, GREEN };

static int add_{k}(int a) {
    return a + {s}; /* } */
}
""", [
        ("struct", "part_{k}", 3, 5, None, None, None, None),
        ("enum", "color_{k}", 7, 7, None, None, None, None),
        ("function", "add_{k}", 9, 11, "static int add_{k} (int a)", None, None, None),
    ]),
    ("cpp", "cpp", """\
namespace parts_{k} {

class Part {
public:
    int size() const { return {s}; }
};

/// Adds.
template <typename T>
T add(T a) {
    return a + {s};
}

}
""", [
        ("module", "parts_{k}", 1, 14, None, None, None, None),
        ("class", "Part", 3, 6, None, None, None, None),
        ("method", "size", 5, 5, "int size () const", "Part", None, None),
        ("function", "add", 9, 12, "template <typename T> T add (T a)", None, None, "Adds."),
    ]),
]


def code_files(part: DataFrame) -> DataFrame:
    """(file_path, content, mtime): one file for each part, the languages in turn."""
    turn = (F.col("p_partkey") % len(SAMPLES) + 1).cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), turn)
    text = pick([s[2] for s in SAMPLES])
    for name, column in (("{k}", "p_partkey"), ("{s}", "p_size")):
        text = F.replace(text, F.lit(name), F.col(column).cast("string"))
    path = F.concat(F.lit("src/"), F.col("p_partkey").cast("string"), F.lit("."), pick([s[1] for s in SAMPLES]))
    return part.select(path.alias("file_path"), text.alias("content"), F.col("p_partkey").alias("mtime"))


def _literal(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _filled(column: str) -> str:
    return f"replace(replace({column}, '{{k}}', p_partkey::VARCHAR), '{{s}}', p_size::VARCHAR)"


def files_sql() -> str:
    """SQL of ``code_files``."""
    rows = ", ".join(f"({i}, {_literal(language)}, {_literal(ext)}, {_literal(text)})" for i, (language, ext, text, _) in enumerate(SAMPLES))
    return f"""(SELECT 'src/' || p_partkey || '.' || ext AS file_path, {_filled('body')} AS content, p_partkey AS mtime, language
  FROM part JOIN (VALUES {rows}) t(i, language, ext, body) ON p_partkey % {len(SAMPLES)} = i)"""


def units_sql() -> str:
    """SQL of the units of ``code_files``."""
    rows = ", ".join(
        f"({i}, {_literal(language)}, {_literal(ext)}, {', '.join(map(_literal, unit))})"
        for i, (language, ext, _, units) in enumerate(SAMPLES) for unit in units
    )
    named = ("name", "signature", "parent", "doc")
    return f"""(SELECT 'src/' || p_partkey || '.' || ext AS file_path, language, kind, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, visibility,
    {', '.join(f"{_filled(c)} AS {c}" for c in named)}
  FROM part JOIN (VALUES {rows}) t(i, language, ext, kind, name, start_line, end_line, signature, parent, visibility, doc) ON p_partkey % {len(SAMPLES)} = i)"""

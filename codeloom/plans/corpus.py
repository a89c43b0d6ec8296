"""Source corpora derived from the ``part`` table, for queries, tests and benchmarks.

One file holds the parts of one brand within a block of 400 part keys, so a file never
grows with the data or with a frequent brand; only the number of files does. The text of
a part is a template with the part key for ``{k}`` and the part size for ``{z}``; ``{b}``
in headers and trailers is the block number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS_PER_FILE = 400

PYTHON_HEADER = '''import os
from math import sqrt, floor

RATE_{b} = {b}


class Catalog_{b}:
    """Prices of block {b}.

    def fake_{b}():
        hidden = {b}
    """
'''
PYTHON_PARTS = (
    '''
    def price_{k}(self, qty):
        rate = {z}
        return qty * rate
''',
    '''
    def quote_{k}(self, qty):
        low = high = {z}
        total = compute(
            rate={z},  # def not_here():
            qty=qty,
        )

        return total + low  # high
''',
    '''
    async def stock_{k}(
        self,
        qty={z},
    ):
        def inner_{k}(n):
            alias = n
            return alias

        return inner_{k}(qty)
''',
    '''
    class Part_{k}:
        size: int = {z}
        label = "class Fake_{k}: # no comment"

        def area_{k}(self):
            return self.size
''',
)
PYTHON_TRAILER = '''

def total_{b}(items):
    return sum(items)


# the end of block {b}
'''

GO_HEADER = "package block{b}\n\nimport \"fmt\"\n"
GO_PARTS = (
    '''
type Item{k} struct {
	size int // not a brace: {
}

func (i *Item{k}) Size{k}(q int) int {
	if q > {z} {
		return i.size * q
	} else {
		fmt.Println("}", q)
	}
	return {z}
}
''',
    '''
const Rate{k} = {z}

var Table{k} = map[string]int{
	"a{": {z},
	"b": 2,
}

func Use{k}() int { return Rate{k} }
''',
    '''
const (
	Low{k}, High{k} = {z}, 2 // not, these = 1
	Sum{k}          = Low{k} +
		High{k}
	Repeated{k}
)

var left{k}, right{k} = pair({z}, 2), "x, y"

type (
	Pair{k} struct {
		a, b int
	}
	Same{k} = int
	List{k} []int
)
''',
)
JAVASCRIPT_PARTS = (
    '''
function price{k}(qty, { rate } = {}) {
  if (qty > {z}) {
    return qty * rate; // }
  } else {
    return "}" + qty;
  }
}

export class Item{k} extends Base {
  constructor() {
    this.size = {z};
  }
}
''',
    '''
const RATE_{k} = {z};

export const table{k} = {
  a: "{",
  b: {z},
};

export async function load{k}() { return table{k}; }
''',
    '''
let low{k} = {z}, high{k} = [2, 3];

const near{k} = 1; const far{k} = { a: 1, b: 2 };

function test{k}(x) {
  if (/[{]/.test(x)) { var deep{k} = {z}; }
  return /[}]/;
}
''',
)
TYPESCRIPT_PARTS = (
    '''
export interface Shape{k} {
  size: number;
  area(scale: number): number;
}

function make{k}(size: number): Shape{k} {
  return {
    size,
    area: (scale: number) => scale * {z},
  };
}
''',
    '''
type Rate{k} = number;

class Box{k} implements Shape {
  label = "}{";
}

const limit{k}: number = {z};
''',
)
RUST_PARTS = (
    '''
pub struct Item{k} {
    size: u64, // {
}

impl Item{k} {
    pub fn new{k}(size: u64) -> Self {
        Item{k} { size }
    }

    fn open<'a>(&'a self) -> char {
        '{'
    }
}

pub const RATE_{k}: u64 = {z};
''',
    '''
enum Kind{k} {
    Small, /* a { /* b { */ c */
    Large { size: u64 },
}

const RAW_{k}: &str = r##"{ "# {"##;

trait Priced{k} {
    fn price{k}(&self) -> u64;
    fn twice{k}(&self) -> u64 {
        {z} * 2
    }
}

static mut COUNT_{k}: u64 = {z};
''',
)


class Layout:
    """File naming and templates of one corpus."""

    def __init__(self, suffix: str, header: str, parts: tuple[str, ...], trailer: str = "") -> None:
        self.suffix, self.header, self.parts, self.trailer = suffix, header, parts, trailer


LAYOUTS = {
    "python": Layout(".py", PYTHON_HEADER, PYTHON_PARTS, PYTHON_TRAILER),
    "go": Layout(".go", GO_HEADER, GO_PARTS),
    "js": Layout(".js", "", JAVASCRIPT_PARTS),
    "ts": Layout(".ts", "", TYPESCRIPT_PARTS),
    "tsx": Layout(".tsx", "", TYPESCRIPT_PARTS),
    "rust": Layout(".rs", "", RUST_PARTS),
}


def _filled(template: Column, **values: Column) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def modules(part: DataFrame, kind: str) -> DataFrame:
    """FILE-like rows ``(path, text)`` of one corpus."""
    layout = LAYOUTS[kind]
    key = F.col("p_partkey")
    templates = F.array(*[F.lit(text) for text in layout.parts])
    rows = part.select(
        F.replace("p_brand", F.lit("#"), F.lit("_")).alias("brand"),
        F.floor(key / KEYS_PER_FILE).alias("block"),
        key.alias("k"),
        _filled(templates[(key % len(layout.parts)).cast("int")], k=key, z=F.col("p_size")).alias("part_text"),
    )
    # At most KEYS_PER_FILE rows per group: part keys are unique.
    grouped = rows.groupBy("brand", "block").agg(F.array_sort(F.collect_list(F.struct("k", "part_text"))).alias("parts"))
    body = F.array_join("parts.part_text", "")
    return grouped.select(
        F.concat("brand", F.lit("/m"), F.col("block").cast("string"), F.lit(layout.suffix)).alias("path"),
        F.concat(
            _filled(F.lit(layout.header), b=F.col("block")), body, _filled(F.lit(layout.trailer), b=F.col("block"))
        ).alias("text"),
    )

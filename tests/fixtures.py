"""Golden sources and their chunks: (id, function, class, start, end, language, type)."""

PYTHON = """DEPTH = 3


class Pond:
    def fill(self, litres):
        for step in range(litres):
            self.level += step

    def __len__(self):
        return self.level


def drain(pond):
    while len(pond):
        pond.level -= 1
    return pond
"""
GO = """package yard

import "os"

var Fence = os.Getenv("FENCE")

const Posts = 12

func Mow(rows int) (cut int) {
	for r := 0; r < rows; r++ {
		cut += r
	}
	return
}

type Gate struct {
	open bool
	bars []string
}

func (g Gate) Swing() bool {
	return !g.open
}
"""
JAVASCRIPT = """let beds = [1, 2];

class Hose {
  spray(bed) { return bed; }
}

function soak(bed) {
  while (bed.dry) {
    bed.dry = !new Hose().spray(bed);
  }
}
"""
RUST = """const ROWS: u8 = 4;

fn sow(rows: u8) -> u8 {
    match rows {
        0 => 1,
        n => n + ROWS,
    }
}

struct Seed {
    kind: String,
    weeks: u8,
}

impl Seed {
    fn ripe(&self) -> bool {
        self.weeks > 9
    }
}
"""
TYPESCRIPT = """type Hours = number;

function shade(h: Hours): Sun {
  if (h > 6) {
    return { h };
  }
  return { h: 0 };
}

interface Sun {
  h: Hours;
}
"""
FILES = [
    ("yard.py", PYTHON),
    ("empty.py", ""),
    ("yard.go", GO),
    ("yard.js", JAVASCRIPT),
    ("yard.rs", RUST),
    ("yard.ts", TYPESCRIPT),
    ("yard.tsx", TYPESCRIPT),
    ("yard.txt", "plain notes"),
    ("yard", "notes"),
]

PYTHON_CHUNKS = {
    ("yard.py_DEPTH_1", "DEPTH", "", 1, 1, "python", "variables"),
    ("yard.py_Pond_4", "", "Pond", 4, 10, "python", "classes"),
    ("yard.py_fill_5", "fill", "Pond", 5, 7, "python", "methods"),
    ("yard.py___len___9", "__len__", "Pond", 9, 10, "python", "methods"),
    ("yard.py_drain_13", "drain", "", 13, 16, "python", "functions"),
}
BRACE_CHUNKS = {
    ("yard.go_Fence_5", "Fence", "", 5, 5, "go", "variables"),
    ("yard.go_Posts_7", "Posts", "", 7, 7, "go", "constants"),
    ("yard.go_Mow_9", "Mow", "", 9, 14, "go", "functions"),
    ("yard.go_Gate_16", "Gate", "", 16, 19, "go", "types"),
    ("yard.go_Swing_21", "Swing", "", 21, 23, "go", "functions"),
    ("yard.js_beds_1", "beds", "", 1, 1, "javascript", "variables"),
    ("yard.js_Hose_3", "", "Hose", 3, 5, "javascript", "classes"),
    ("yard.js_soak_7", "soak", "", 7, 11, "javascript", "functions"),
    ("yard.rs_ROWS_1", "ROWS", "", 1, 1, "rust", "constants"),
    ("yard.rs_sow_3", "sow", "", 3, 8, "rust", "functions"),
    ("yard.rs_Seed_10", "Seed", "", 10, 13, "rust", "structs"),
    ("yard.rs_impls_15", "", "", 15, 19, "rust", "impls"),
    ("yard.rs_ripe_16", "ripe", "", 16, 18, "rust", "functions"),
} | {
    row
    for suffix in ("ts", "tsx")
    for row in (
        (f"yard.{suffix}_Hours_1", "Hours", "", 1, 1, "typescript", "types"),
        (f"yard.{suffix}_shade_3", "shade", "", 3, 8, "typescript", "functions"),
        (f"yard.{suffix}_Sun_10", "Sun", "", 10, 12, "typescript", "interfaces"),
    )
}
CONTENTS = {
    "yard.py___len___9": "def __len__(self):\n        return self.level",
    "yard.py_DEPTH_1": "DEPTH = 3",
    "yard.go_Gate_16": "type Gate struct {\n\topen bool\n\tbars []string\n}",
    "yard.js_beds_1": "let beds = [1, 2];",
    "yard.rs_ripe_16": "fn ripe(&self) -> bool {\n        self.weeks > 9\n    }",
    "yard.rs_ROWS_1": "const ROWS: u8 = 4;",
    "yard.ts_Hours_1": "type Hours = number;",
}

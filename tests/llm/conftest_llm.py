from pathlib import Path
from runpy import run_path

ODD = run_path(str(Path(__file__).with_name("conftest.py")))["ODD"]

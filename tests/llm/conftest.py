import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[2])
# Python workers import the operators by name
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)
sys.path[:0] = [str(Path(__file__).resolve().parent)]

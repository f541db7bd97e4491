"""The entry point without the optional training-data operators."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(code):
    done = subprocess.run(
        [sys.executable, "-c", f"import sys; {code}; import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"],
        cwd=ROOT, capture_output=True, text=True)
    return done.returncode, done.stdout.split(), done.stderr


@pytest.mark.parametrize("gone", ["corpus_pipeline", "statweave.llm", "statweave.llm.queries", "ahocorasick", "tiktoken"])
def test_missing_parts_leave_the_rest(gone):
    code, found, errors = names(f"sys.modules[{gone!r}] = None")
    assert code == 0, errors
    assert "left out" in errors and "describe_orders" in found and "pipeline" not in found and not any(n.startswith("op1_") for n in found)


def test_other_import_errors_are_not_hidden():
    code, _, errors = names("sys.modules['statweave.functions.keys'] = None")
    assert code != 0 and "ModuleNotFoundError" in errors


def test_nothing_else_imports_the_optional_part():
    for folder, _, files in os.walk(os.path.join(ROOT, "statweave")):
        for name in files:
            if name.endswith(".py") and not folder.endswith("llm"):
                with open(os.path.join(folder, name)) as file:
                    assert "statweave.llm" not in file.read()

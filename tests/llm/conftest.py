import pytest

pytest.importorskip("fieldloom.llm")

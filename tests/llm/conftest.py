import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from conftest_llm import doc_schema, labels, make_docs, no_docs, odd_docs  # noqa: E402, F401

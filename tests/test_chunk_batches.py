"""chunk_files passes chunks on in parts, whatever a batch of files holds."""

import pyarrow as pa

from siftwork.functions import chunkers


class Files:
    """What chunk_files asks of a DataFrame; gives the function that the tasks run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_parts_of_a_batch():
    n, size = 40, 1 << 20
    text = "x" * size
    files = pa.RecordBatch.from_arrays([pa.array([*(f"/a/{i}.md" for i in range(n)), "/a/none.py", "/a/f.py"]), pa.array([*[text] * n, None, "def f():\n    pass\n"])], ["path", "content"])
    parts = list(chunkers.chunk_files(Files())(iter([files, files.slice(0, 0)])))
    assert max(p.nbytes for p in parts) <= chunkers.HELD + 2 * size
    rows = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    assert rows == [*((f"/a/{i}.md", 0, 1, 1, "file", "", text) for i in range(n)), ("/a/none.py", 0, 1, 1, "file", "", ""), ("/a/f.py", 0, 1, 2, "function", "f", "def f():\n    pass")]

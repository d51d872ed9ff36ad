"""Listing of folders with empty and hidden files."""

from cuesheet.operators.order import in_order
from cuesheet.sources.files import file_info
from cuesheet.sources.tree import list_tree

FILES = {"b.pdf": 131072, ".hidden.pdf": 3, "_under/a.pdf": 0, "s/t/u/v/deep.pdf": 2, "s/t/x.txt": 1, "s/.h/y.pdf": 1, "z.PDF": 1}


def test_all_files_are_found(spark, tmp_path):
    for name, size in FILES.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)
    (tmp_path / "s" / "folder.pdf").mkdir()
    (tmp_path / "gone.pdf").symlink_to(tmp_path / "nothing")
    rows = list_tree(spark, str(tmp_path)).collect()
    found = {r.path[len(str(tmp_path)) + 1 :]: r for r in rows}
    assert len(found) == len(rows)
    assert {p: r.size for p, r in found.items() if r.is_file} == FILES
    assert {p for p, r in found.items() if r.is_dir} == {"_under", "s", "s/t", "s/t/u", "s/t/u/v", "s/.h", "s/folder.pdf"}
    assert all(abs(r.modified.timestamp() - (tmp_path / p).stat().st_mtime) < 1 for p, r in found.items())
    scripts = list_tree(spark, f"file://{tmp_path}", ".pdf").where("is_file")
    want = sorted(str(tmp_path / p) for p in FILES if p.endswith(".pdf"))
    assert [r.path for r in in_order(scripts, "path", "position").orderBy("position").collect()] == want
    assert {r.name: r.size_mb for r in file_info(scripts).collect()}["b.pdf"] == 0.12


def test_no_folder(spark, tmp_path):
    assert list_tree(spark, str(tmp_path / "none")).collect() == [] == list_tree(spark, str(tmp_path)).collect()

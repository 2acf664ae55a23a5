from pathlib import Path


def make(root: Path, files: dict[str, str]) -> Path:
    """A source tree; every folder below src or a package gets an __init__.py unless it is given."""
    for name, text in files.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text, encoding="utf-8")
    return root


def project(name="acme", deps=(), more=""):
    return f'[project]\nname = "{name}"\nversion = "1"\ndependencies = [{", ".join(repr(d) for d in deps)}]\n{more}\n'

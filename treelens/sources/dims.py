"""Dimension tables: the standard library, known import names and commands, and what a virtual environment holds."""

from __future__ import annotations

import csv
import re
import sys
from pathlib import Path

from treelens.sources.requirements import normalize

#: Standard modules that the running version no longer has, and the last minor version with them (fixed values).
REMOVED = {11: "asynchat asyncore binhex distutils imp smtpd", 12: "aifc audioop cgi cgitb chunk crypt imghdr mailcap msilib nis nntplib ossaudiodev pipes sndhdr spwd sunau telnetlib uu xdrlib lib2to3"}
#: Standard modules and the first minor version with them (fixed values).
ADDED = {11: "tomllib", 14: "annotationlib compression"}

#: Distributions whose import names differ from their own (fixed values, from their published metadata).
IMPORTS = {
    "attrs": "attr attrs", "beautifulsoup4": "bs4", "dnspython": "dns", "grpcio": "grpc", "msgpack-python": "msgpack", "mysqlclient": "MySQLdb", "opencv-python": "cv2",
    "pillow": "PIL", "protobuf": "google", "psycopg2-binary": "psycopg2", "pycryptodome": "Crypto", "pyjwt": "jwt", "pymysql": "pymysql", "pyopenssl": "OpenSSL",
    "pyserial": "serial", "python-dateutil": "dateutil", "python-docx": "docx", "python-dotenv": "dotenv", "python-jose": "jose", "python-magic": "magic", "python-multipart": "multipart",
    "python-slugify": "slugify", "pyyaml": "yaml", "pyzmq": "zmq", "scikit-image": "skimage", "scikit-learn": "sklearn", "setuptools": "setuptools pkg_resources", "typing-extensions": "typing_extensions",
    "websocket-client": "websocket", "djangorestframework": "rest_framework", "google-cloud-storage": "google", "markdown": "markdown", "ruamel-yaml": "ruamel", "pytest-asyncio": "pytest_asyncio",
}
#: Distributions that are imported by their own name (fixed values).
PLAIN = (
    "aiohttp alembic anyio black boto3 botocore brotli celery certifi click coverage cryptography django fastapi flake8 flask gunicorn h11 httpcore httpx hypothesis "
    "idna isort jinja2 jsonschema kombu lxml matplotlib mkdocs mypy networkx nox numpy packaging pandas pip pluggy pydantic pygments pylint pytest redis requests rich "
    "ruff scipy seaborn sphinx sqlalchemy starlette sympy toml tornado tox tqdm twine tzdata ujson urllib3 uvicorn uvloop virtualenv watchdog werkzeug wheel"
).split()
#: Commands and the distributions they come from (fixed values).
BINARIES = {
    "alembic": "alembic", "autopep8": "autopep8", "bandit": "bandit", "black": "black", "build": "build", "celery": "celery", "cog": "cogapp", "cogapp": "cogapp", "coverage": "coverage", "django-admin": "django",
    "flake8": "flake8", "flask": "flask", "gunicorn": "gunicorn", "hatch": "hatch", "isort": "isort", "jupyter": "jupyter", "mkdocs": "mkdocs", "mypy": "mypy", "nox": "nox", "pip": "pip",
    "pip-compile": "pip-tools", "poetry": "poetry", "pre-commit": "pre-commit", "py.test": "pytest", "pylint": "pylint", "pyright": "pyright", "pytest": "pytest", "pyupgrade": "pyupgrade", "ruff": "ruff",
    "sphinx-apidoc": "sphinx", "sphinx-build": "sphinx", "towncrier": "towncrier", "tox": "tox", "twine": "twine", "uvicorn": "uvicorn", "virtualenv": "virtualenv", "watchmedo": "watchdog", "wheel": "wheel", "yamllint": "yamllint",
}


def stdlib(minor: int) -> set[str]:
    """Top-level standard modules of a version, from those of the running one."""
    names = {n for n in sys.stdlib_module_names}
    for last, gone in REMOVED.items():
        if minor <= last:
            names |= set(gone.split())
    for first, new in ADDED.items():
        if minor < first:
            names -= set(new.split())
    return names


def bundled() -> list[tuple[str, str]]:
    """import_root, distribution."""
    return [(i, d) for d, names in IMPORTS.items() for i in names.split()] + [(d.replace("-", "_"), d) for d in PLAIN]


def site_packages(root: Path) -> Path | None:
    for env in (".venv", "venv"):
        for at in (root / env / "Lib/site-packages", *sorted((root / env / "lib").glob("*/site-packages"))):
            if at.is_dir():
                return at
    return None


def installed(root: Path) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(import_root, distribution) and (binary, distribution) of the project's environment."""
    imports, binaries = set(), set()
    at = site_packages(root)
    for info in sorted(at.glob("*.dist-info")) if at else []:
        read = lambda n: (info / n).read_text("utf-8", "replace") if (info / n).is_file() else ""  # noqa: B023, E731
        head = read("METADATA").split("\n\n")[0]
        name = re.search(r"^Name:\s*(.+)$", head, re.M)
        if not name:
            continue
        dist = normalize(name[1].strip())
        roots = {x.split(";")[0].split(".")[0].strip() for x in re.findall(r"^Import-Name(?:space)?:\s*(.+)$", head, re.M)}
        if not roots:
            roots = {x.strip() for x in read("top_level.txt").splitlines() if x.strip() and not x.startswith("_")}
        if not roots:
            for row in csv.reader(read("RECORD").splitlines()):
                first, _, rest = (row[0] if row else "").partition("/")
                if rest and "." not in first and not first.startswith("_"):
                    roots.add(first)
                elif not rest and first.endswith(".py") and not first.startswith("_"):
                    roots.add(first[:-3])
        imports |= {(r, dist) for r in roots if r}
        section = ""
        for line in read("entry_points.txt").splitlines():
            if line.startswith("["):
                section = line.strip("[] \t")
            elif section == "console_scripts" and "=" in line:
                binaries.add((line.split("=")[0].strip(), dist))
    return sorted(imports), sorted(binaries)

"""A small corpus of source files of our own, for rules that prose never triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES: list[tuple[str, str, str]] = [
    ("app/pricing.py", "python", "RATE = 7\n\n\n\ndef total(items, rate):\n    # loop over the items\n    out = []\n    for i in range(len(items)):\n        if items[i] == None:\n            continue\n        out.append(items[i] * 37)\n    return list([x for x in out])\n\n\ndef known(table, key):\n    if key in table.keys():\n        return table[key]\n    raise ValueError('not implemented')\n"),
    ("app/report.py", "python", "import os\n\n# first line of a block\n# second line of a block\n# third line of it\n# fourth line of it\ndef show(rows):\n    # print the rows\n    limit = os.getenv('REPORT_LIMIT')\n    for row in rows:\n        if row and row[0] > 3 or limit:\n            print(row)\n    # one\n    # two\n    # three\n    # four\n    return None\n"),
    ("web/cart.js", "javascript", "var total = 0;\nasync function load(id) {\n  // fetch the cart\n  if (id == null) { return; }\n  const found = await fetch('/cart/' + id);\n  return await found.json();\n}\nfunction add(a, b) { return a === b ? 12.5 : a != b; }\n"),
    ("web/view.ts", "typescript", "const width = 640;\nexport function view(n: number) {\n  // ----------------\n  // build the view\n  while (n > 1) { n = n / 2; }\n  return n !== 1 && n == 0;\n}\n"),
    ("core/store.rs", "rust", "const MAX: usize = 99;\nfn name(x: &str) -> String {\n    let out = format!(\"{}\", x);\n    out\n}\nfn later() { todo!(\"write it\"); }\nfn size(v: &[u8]) -> usize { if v.len() > 17 { 1 } else { 2 } }\n"),
    ("core/rules.clj", "clojure", "(ns core.rules)\n(defn same [a b] (not (= a b)))\n(defn there [x] (not (nil? x)))\n(defn flag [x] (if (pos? x) true false))\n(defn none [xs] (= (count xs) 0))\n(defn some-of [xs] (> (count xs) 0))\n(defn copy [xs] (reduce conj [] xs))\n(defn act [x] (when x (do (inc x))))\n(defn one [] (let [a 5] (inc a)))\n"),
    ("core/mesh.jl", "julia", "function area(xs)\n    if length(xs) == 0\n        return 0\n    end\n    for i in 1:length(xs)\n        println(xs[i])\n    end\n    if xs == nothing\n        error(\"TODO\")\n    end\n    return 42\nend\n"),
    ("notes/plain.txt", "generic", "alpha beta\n\n\n\ngamma # step 3 of it\nplaceholder\n"),
    ("app/copy_a.py", "python", "def collect(rows, key, limit):\n    seen = {}\n    for row in rows:\n        value = row.get(key)\n        if value is not None and value > limit:\n            seen[value] = seen.get(value, 0) + 1\n    return sorted(seen.items())\n"),
    ("app/copy_b.py", "python", "X = 1\n\ndef collect(rows, key, limit):\n    seen = {}\n    for row in rows:\n        value = row.get(key)\n        if value is not None and value > limit:\n            seen[value] = seen.get(value, 0) + 1\n    return sorted(seen.items())\n"),
    ("app/copy_c.py", "python", "def gather(lines, name, most):\n    found = {}\n    for line in lines:\n        item = line.get(name)\n        if item is not None and item > most:\n            found[item] = found.get(item, 0) + 1\n    return sorted(found.items())\n"),
]
FILE_COLUMNS = "path string, lang string, text string"

#: Configuration files and the places where code touches their keys: (path, line, key, kind).
CONFIG: list[tuple[str, str]] = [
    ("conf/app.toml", "[server]\nport-number = 80\nhost_name = \"x\"\nreport_limit = 5\n# comment\nunused-key = 1\n"),
    ("conf/jobs.yaml", "retries: 3\ntimeout_seconds: 9\nnested:\n  deep_key: a\n- item: 1\n"),
    ("conf/ui.json", "{\n  \"themeColor\": \"red\",\n  \"fontSize\": 12\n}\n"),
    ("package.json", "{\n  \"scriptsOnly\": 1\n}\n"),
]
USES: list[tuple[str, int, str, str]] = [
    ("a.py", 3, "port_number", "parsed"), ("a.py", 9, "PORT_NUMBER", "live"), ("a.py", 4, "host_name", "parsed"), ("b.py", 1, "hostName", "echoed"),
    ("b.py", 8, "retries", "parsed"), ("b.py", 9, "retries", "shadowed"), ("b.py", 12, "themeColor", "stored"), ("b.py", 13, "font_size", "parsed"), ("c.py", 2, "fontSize", "echoed"),
]


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, FILE_COLUMNS)


#: A package of our own, for what reads syntax trees.
MODULES: list[tuple[str, str, str]] = [
    ("shop/__init__.py", "python", "from shop.base import Item\n"),
    ("shop/base.py", "python", "import os\nfrom . import rates\n\n\nclass Item:\n    kind = 'item'\n\n    def price(self, n, rate=1):\n        if n > 3:\n            return n * rate\n        elif n < 0:\n            raise ValueError(n)\n        return self.round(n)\n\n    def round(self, n):\n        return int(n)\n"),
    ("shop/rates.py", "python", "RATE = 2\n\n\ndef rate(n):\n    def inner(k):\n        return k + n + RATE\n\n    total = 0\n    for k in range(n):\n        while k > 3:\n            k = k - 1\n            if k == 2:\n                break\n        total += inner(k)\n    return total if total else (lambda q: q)(n)\n"),
    ("shop/cart.py", "python", "import shop.rates as rates\nfrom shop.base import Item\n\n\nclass Cart(Item):\n    def total(self, items):\n        out = [self.price(x, rate=rates.rate(x)) for x in items]\n        try:\n            return sum(out)\n        except TypeError as e:\n            print(e)\n        return Item.round(self, 0)\n"),
    ("tools/rates.py", "python", "def rate(n):\n    return n\n"),
    ("tools/marks.py", "python", "from dataclasses import dataclass\nimport functools\n\n\n@dataclass\nclass Mark:\n    x: int = 0\n\n    @property\n    def double(self):\n        return self.x * 2\n\n    @functools.cache\n    def slow(self):\n        return self.x\n"),
    ("tools/use.py", "python", "import rates\nfrom shop import cart\n\nrates.rate(1)\nprint(cart.Cart().total([]))\n"),
]


def modules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES + MODULES, FILE_COLUMNS)

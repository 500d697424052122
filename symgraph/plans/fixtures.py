"""Small sources of our own, for the parser and the resolver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symgraph.sources.parse import parse_files

PYTHON = {
    "shop/base.py": '''"""Records."""
from typing import overload


class Record:
    """Something kept."""

    table = "records"

    def save(self):
        """Keep it."""
        self.check()
        return write(self)

    def check(self):
        return True


def write(record):
    def flush():
        return record
    return flush()
''',
    "shop/orders.py": '''import shop.util as u
from shop.base import Record as Base, write as put


def audited(f):
    return f


class Order(Base):
    @property
    def total(self):
        return u.add(1, 2)

    @total.setter
    def total(self, value):
        self.value = value

    @audited
    def save(self):
        super().save()
        self.total
        return put(self)

    def check(self):
        return self.again()

    def again(self):
        return self.check()


class Rush(Order):
    def __init__(self):
        super().__init__()

    def save(self):
        return super().save()


def place(order):
    rush = Rush()
    rush.hurry()
    return order.save()
''',
    "shop/util.py": '''from typing import overload


@overload
def add(a: int, b: int): ...
def add(a, b):
    return total(a) + b


def total(a):
    return total(a)


class Order:
    def hurry(self):
        return add(1, 2)
''',
    "shop/broken.py": "def (:\n",
    "shop/empty.py": "",
}
SCRIPT = {
    "web/base.ts": """export abstract class Shape {
  size = 1;
  constructor() { register(this); }
  abstract area(): number;
  describe(): string { return this.area().toString(); }
}

/** Keeps a shape. */
export function register(shape: Shape): void {
  store.put(shape);
}
""",
    "web/app.ts": """import { register as keep } from './base';
import * as tools from './tools/index';

export class Circle extends Shape implements Drawable<string> {
  constructor(private r: number) { super(); }
  area(): number { return tools.square(this.r); }
  onClick = () => { this.describe(); items.map(x => keep(x)); };
}

const api = {
  load() { return fetchAll(); },
  save: async (x: number) => { await new Circle(x).area(); },
};

const twice = (n: number): number => n + n;
function outer() {
  function inner() { return twice(2); }
  return inner();
}
""",
    "web/tools/index.ts": """export function square(n: number) { return n * n; }
""",
}


def files(spark: SparkSession, language: str | None = None) -> DataFrame:
    """repo_url, path, language, content."""
    rows = [("fixture", p, "python", s) for p, s in PYTHON.items()] + [("fixture", p, "typescript", s) for p, s in SCRIPT.items()]
    return spark.createDataFrame([r for r in rows if language in (None, r[2])], "repo_url string, path string, language string, content string")


def chunks(spark: SparkSession, language: str | None = None) -> DataFrame:
    """The symbols of the sources."""
    return parse_files(files(spark, language))


def expected(rows: str, columns: str) -> str:
    """SQL for rows written a line each, their cells between bars; numbers are numbers."""
    cell = lambda c: c if c.isdigit() else "'" + c.replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(cell(c.strip()) for c in line.split("|")) + ")" for line in rows.strip().splitlines())
    return f"SELECT * FROM (VALUES {values}) AS t({columns})"


#: What the sources above hold: recorded from the parsers and the resolver, then read against the sources, line by line.
PYTHON_SYMBOLS = """
shop/base.py | Record | Record | class | 5 | 16 | Something kept. |  |
shop/base.py | Record.save | save | method | 10 | 13 | Keep it. | self.check write |
shop/base.py | Record.check | check | method | 15 | 16 |  |  |
shop/base.py | write | write | function | 19 | 22 |  | flush |
shop/base.py | write.flush | flush | function | 20 | 21 |  |  |
shop/orders.py | audited | audited | function | 5 | 6 |  |  |
shop/orders.py | Order | Order | class | 9 | 28 |  |  | Record
shop/orders.py | Order.total | total | method | 11 | 12 |  | property util.add |
shop/orders.py | Order.total#2 | total | method | 15 | 16 |  | total.setter |
shop/orders.py | Order.save | save | method | 19 | 22 |  | audited super super.save write |
shop/orders.py | Order.check | check | method | 24 | 25 |  | self.again |
shop/orders.py | Order.again | again | method | 27 | 28 |  | self.check |
shop/orders.py | Rush | Rush | class | 31 | 36 |  |  | Order
shop/orders.py | Rush.__init__ | __init__ | method | 32 | 33 |  | super super.__init__ |
shop/orders.py | Rush.save | save | method | 35 | 36 |  | super super.save |
shop/orders.py | place | place | function | 39 | 42 |  | Rush order.save rush.hurry |
shop/util.py | add | add | function | 6 | 7 |  | total |
shop/util.py | total | total | function | 10 | 11 |  | total |
shop/util.py | Order | Order | class | 14 | 16 |  |  |
shop/util.py | Order.hurry | hurry | method | 15 | 16 |  | add |
"""
SCRIPT_SYMBOLS = """
web/app.ts | Circle | Circle | class | 4 | 8 |  |  | Shape
web/app.ts | Circle.constructor | constructor | method | 5 | 5 |  | super.constructor |
web/app.ts | Circle.area | area | method | 6 | 6 |  | tools.square |
web/app.ts | Circle.onClick | onClick | method | 7 | 7 |  | items.map register this.describe |
web/app.ts | api.load | load | function | 11 | 11 |  | fetchAll |
web/app.ts | api.save | save | function | 12 | 12 |  | Circle Circle.area |
web/app.ts | twice | twice | function | 15 | 15 |  |  |
web/app.ts | outer | outer | function | 16 | 19 |  | inner |
web/app.ts | outer.inner | inner | function | 17 | 17 |  | twice |
web/base.ts | Shape | Shape | class | 1 | 6 |  |  |
web/base.ts | Shape.constructor | constructor | method | 3 | 3 |  | register |
web/base.ts | Shape.describe | describe | method | 5 | 5 |  | this.area this.area.toString |
web/base.ts | register | register | function | 9 | 11 | Keeps a shape. | store.put |
web/tools/index.ts | square | square | function | 1 | 1 |  |  |
"""
EDGES = """
CALLS | shop/base.py | Record.save | shop/base.py | Record.check
CALLS | shop/base.py | Record.save | shop/base.py | write
CALLS | shop/base.py | write | shop/base.py | write.flush
CALLS | shop/orders.py | Order.again | shop/orders.py | Order.check
CALLS | shop/orders.py | Order.check | shop/orders.py | Order.again
CALLS | shop/orders.py | Order.save | shop/base.py | Record.save
CALLS | shop/orders.py | Order.save | shop/base.py | write
CALLS | shop/orders.py | Order.save | shop/orders.py | audited
CALLS | shop/orders.py | Order.total | shop/util.py | add
CALLS | shop/orders.py | Rush.save | shop/orders.py | Order.save
CALLS | shop/orders.py | place | shop/orders.py | Rush
CALLS | shop/orders.py | place | shop/util.py | Order.hurry
CALLS | shop/util.py | Order.hurry | shop/util.py | add
CALLS | shop/util.py | add | shop/util.py | total
CALLS | web/app.ts | Circle.area | web/tools/index.ts | square
CALLS | web/app.ts | Circle.constructor | web/base.ts | Shape.constructor
CALLS | web/app.ts | Circle.onClick | web/base.ts | Shape.describe
CALLS | web/app.ts | Circle.onClick | web/base.ts | register
CALLS | web/app.ts | api.save | web/app.ts | Circle
CALLS | web/app.ts | api.save | web/app.ts | Circle.area
CALLS | web/app.ts | outer | web/app.ts | outer.inner
CALLS | web/app.ts | outer.inner | web/app.ts | twice
CALLS | web/base.ts | Shape.constructor | web/base.ts | register
CALLS | web/base.ts | Shape.describe | web/app.ts | Circle.area
HAS_METHOD | shop/base.py | Record | shop/base.py | Record.check
HAS_METHOD | shop/base.py | Record | shop/base.py | Record.save
HAS_METHOD | shop/orders.py | Order | shop/orders.py | Order.again
HAS_METHOD | shop/orders.py | Order | shop/orders.py | Order.check
HAS_METHOD | shop/orders.py | Order | shop/orders.py | Order.save
HAS_METHOD | shop/orders.py | Order | shop/orders.py | Order.total
HAS_METHOD | shop/orders.py | Order | shop/orders.py | Order.total#2
HAS_METHOD | shop/orders.py | Rush | shop/orders.py | Rush.__init__
HAS_METHOD | shop/orders.py | Rush | shop/orders.py | Rush.save
HAS_METHOD | shop/util.py | Order | shop/util.py | Order.hurry
HAS_METHOD | web/app.ts | Circle | web/app.ts | Circle.area
HAS_METHOD | web/app.ts | Circle | web/app.ts | Circle.constructor
HAS_METHOD | web/app.ts | Circle | web/app.ts | Circle.onClick
HAS_METHOD | web/base.ts | Shape | web/base.ts | Shape.constructor
HAS_METHOD | web/base.ts | Shape | web/base.ts | Shape.describe
INHERITS | shop/orders.py | Order | shop/base.py | Record
INHERITS | shop/orders.py | Rush | shop/orders.py | Order
INHERITS | web/app.ts | Circle | web/base.ts | Shape
"""

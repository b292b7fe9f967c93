"""N-gram Jaccard join by chosen paths.

1. A text is the set of its runs of `width` words.  Equal sets (by a 128-bit hash) are one
   class, so copies cost one row.  A class has a sketch: 64 min-hash coordinates, whole for the
   first step and four bits each after that.
2. Chosen path: in each run a node samples each coordinate and sends a class to the child
   (coordinate, value).  A pair at the wanted similarity shares one child on average at the
   root, and two below it.  A child of at most `small` classes is searched by brute force over
   sketches, and so is a larger one whose search ends within a budget in proportion to its size
   (a dense group does, since what is found leaves the search); what the budget leaves is split
   again.  Runs are repeated until the chance to miss a pair is below 1 - `recall`, whatever
   the depth.  Searches emit a star for each group found, never all pairs.
3. The forest's components are candidates.  Inside each, exact Jaccard similarities of the
   whole sets give every link between two classes of a component, the number of links of each,
   and the final groups.  In a large component most pairs follow from what each class shares
   with one of them; the rest are compared in blocks of bounded size.

Defined cases: null text is empty; texts without words are equal to each other and similar
to nothing else; a text of fewer than `width` words is one shingle; rows that repeat a
doc_id, or have none, are documents of their own; ties don't matter (the class id is the least
doc_id, null only if all are null); other columns, whatever their names, are ignored; an empty
table gives an empty result.  A text is held whole, at some 20 bytes a byte at most.
"""

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from twinsift.operators.components import connected_components

from . import kernels as K

T = 64
_RND = np.random.Generator(np.random.PCG64(64))
_MUL = _RND.integers(0, 2**32, T, dtype=np.uint32) | np.uint32(1)
_ADD = _RND.integers(0, 2**32, T, dtype=np.uint32)
# Zero nibbles of each byte, to count equal coordinates of two sketches.
_EQUAL = np.array([(b & 15 == 0) + (b >> 4 == 0) for b in range(256)], dtype=np.uint8)


BELOW = 2.0  # children of a node that a pair at the similarity shares on average, below the root
BUDGET = 1024  # comparisons of sketches for each row of a node
HOLD = 1 << 18  # rows of a node that are searched at once; a larger node is only split


def runs_for(recall, similarity):
    """Runs after which a pair at the similarity was met with chance `recall`, if every node
    that it shares is split, to any depth."""
    met = 1.0
    for _ in range(200):
        met = 1 - math.exp(-BELOW * met)
    return math.ceil(math.log(1 - recall) / -met)


def unique_shingles(column, width):
    """For each text the sorted distinct 64-bit shingle hashes."""
    for a, b in K.slices(column):
        h, doc = K.shingles(*K.flat(column.slice(a, b - a)), width)
        ends = np.searchsorted(doc, np.arange(b - a + 1))
        for i in range(b - a):
            yield np.unique(h[ends[i] : ends[i + 1]])


def signatures(sets):
    """(rows, T) min-hash coordinates of a list of sets; all ones for an empty one."""
    size = np.array([len(s) for s in sets])
    out = np.full((len(sets), T), 0xFFFFFFFF, dtype=np.uint32)
    some = np.flatnonzero(size)
    if len(some):
        flat = np.concatenate([sets[i] for i in some])
        h = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
        at = np.cumsum(size[some]) - size[some]
        for t in range(T):
            v = (h ^ _ADD[t]) * _MUL[t]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            v ^= v >> np.uint32(12)
            out[some, t] = np.minimum.reduceat(v, at)
    return out


def narrow(sig):
    """Four bits of each coordinate, two to a byte."""
    x = (sig ^ (sig >> np.uint32(16)) ^ (sig >> np.uint32(7))) & np.uint32(15)
    return (x[:, 0::2] | (x[:, 1::2] << np.uint32(4))).astype(np.uint8)


def _hash(*parts):
    return xxhash.xxh3_64_intdigest(b"|".join(str(p).encode() for p in parts))


def sampled(node, similarity, mean=1.0):
    """Coordinates that a node samples, so that a pair at the similarity shares `mean`
    children; a function of the node alone."""
    rng = np.random.Generator(np.random.PCG64(node))
    return np.flatnonzero(rng.random(T) < mean / (similarity * T))


def _child(node, t, values):
    k = K.mix(np.full(len(values), node, dtype=np.uint64) * np.uint64(31) + np.uint64(t + 1))
    return K.mix(k ^ (values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def stars(names, sketch, least, budget=None):
    """(head, member) pairs of names that join what agrees in at least `least` coordinates,
    through others or not, with the least name first, so that runs repeat the same pairs; and
    the rows that are still to be compared with each other when `budget` comparisons are spent.
    A row that isn't among them was compared with all that are."""
    order = np.argsort(names, kind="stable")
    left, edges, spent = order, [], 0
    while len(left):
        head, left = left[0], left[1:]
        todo = [head]
        while todo and len(left):
            spent += len(left)
            if budget is not None and spent > budget:
                return edges, np.concatenate([left, np.array(todo)])
            same = _EQUAL[sketch[left] ^ sketch[todo.pop()]].sum(1, dtype=np.int64) >= least
            new, left = left[same], left[~same]
            todo.extend(new.tolist())
            edges.extend((names[head], names[j]) for j in new)
    return edges, left


def fixed(column, width):
    """A binary column of values of one width as a matrix."""
    return K.flat(column)[0].reshape(len(column), width)


def _buckets(small, last, similarity, least):
    """Handles the rows of a level, sorted by node: edges of what is searched, children of what
    is split.  A node of more than HOLD rows streams through in parts, which are only split."""

    def batch(edges, kids):
        src, dst = (np.array([e[i] for e in edges], dtype=np.int64) for i in (0, 1))
        node, cid, sketch = (np.concatenate([k[i] for k in kids]) if kids else np.zeros((0, T // 2) if i == 2 else 0, np.uint8 if i == 2 else np.int64) for i in range(3))
        e, k = len(src), len(node)
        none = lambda n, t: pa.nulls(n, t)
        cells = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer((np.arange(k + 1) * (T // 2)).astype("<i4").tobytes()), pa.py_buffer(sketch.tobytes())])
        cols = [(pa.array(src), none(k, pa.int64())), (pa.array(dst), none(k, pa.int64())), (none(e, pa.int64()), pa.array(node)), (none(e, pa.int64()), pa.array(cid)), (none(e, pa.binary()), cells)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in cols], ["src", "dst", "node", "cid", "sketch"])

    def split(node, cid, sketch):
        for t in sampled(int(node) & (2**64 - 1), similarity, BELOW):
            value = (sketch[:, t // 2] >> np.uint8(4 * (t % 2))) & np.uint8(15)
            yield _child(np.uint64(int(node) & (2**64 - 1)), int(t), value).view(np.int64), cid, sketch

    def run(batches):
        edges, kids, held = [], [], []

        def close(node, more=False):
            """Handles the rows held of a node; `more` of it are to come, or came before."""
            nonlocal held
            cid, sketch = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            held = []
            if more:
                kids.extend(split(node, cid, sketch))
            elif len(cid) > 1:
                free = last or len(cid) <= small
                found, rest = stars(cid, sketch, least, None if free else BUDGET * len(cid))
                edges.extend(found)
                if len(rest):
                    kids.extend(split(node, cid[rest], sketch[rest]))

        now, big = None, False
        for b in batches:
            node, cid, sketch = b["node"].to_numpy(), b["cid"].to_numpy(), fixed(b["sketch"], T // 2)
            first = np.flatnonzero(np.diff(node)) + 1
            for x, y in zip([0, *first], [*first, len(node)] if len(node) else []):
                if held and node[x] != now:
                    close(now, big)
                if node[x] != now:
                    now, big = node[x], False
                held.append((cid[x:y], sketch[x:y]))
                if not last and sum(len(h[0]) for h in held) > HOLD:
                    big = True
                    close(now, True)
                if len(edges) + sum(len(k[0]) for k in kids) > 50_000:
                    yield batch(edges, kids)
                    edges, kids = [], []
        if held:
            close(now, big)
        yield batch(edges, kids)

    return run


def similar_groups(docs, text="text", key="doc_id", width=5, similarity=0.8, recall=0.999999, small=256, depth=8, block=256, prints=False):
    """One row for each row of `docs`: key, class_id (least key of its group of linked
    documents), n_links (other documents at the similarity or more), set_size.  With `prints`
    also print and class_print, the hashes of its text and of the text of the row that
    class_id is from, which tell rows of one key apart."""
    spark = K.checkpoint_dir(docs.sparkSession)
    docs = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("print", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketch(batches):
        for b in K.parts(batches, "text"):
            sets = list(unique_shingles(b["text"], width))
            name = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            halves = [pa.array([(n >> k) % 2**64 - 2**63 for n in name], pa.int64()) for k in (0, 64)]
            sig = signatures(sets)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["print"], *halves, pa.array([len(s) for s in sets], pa.int64()), pa.array([r.tobytes() for r in sig], pa.binary())], ["doc_id", "print", "low", "high", "set_size", "sig"])

    seen = docs.mapInArrow(sketch, f"doc_id {kind}, print long, low long, high long, set_size long, sig binary").checkpoint()
    # the row that stands for a class; its text's hash tells rows of one key apart
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("first")
    classes = seen.groupBy("low", "high").agg(first, F.count("*").alias("copies"), F.max("set_size").alias("set_size"), F.first("sig").alias("sig"))
    classes = classes.select(F.monotonically_increasing_id().alias("cid"), "low", "high", F.col("first.doc_id").alias("rep"), F.col("first.print").alias("rep_print"), "copies", "set_size", "sig").checkpoint()
    runs = runs_for(recall, similarity)
    roots = [_hash("run", r) for r in range(runs)]
    least = int(T * (similarity - 0.27))  # five standard deviations below

    def start(batches):
        for b in batches:
            sig = fixed(b["sig"], 4 * T).view("<u4")
            thin = pa.array([r.tobytes() for r in narrow(sig)], pa.binary())
            for root in roots:
                for t in sampled(root, similarity):
                    yield pa.RecordBatch.from_arrays([pa.array(_child(np.uint64(root), int(t), sig[:, t]).view(np.int64)), b["cid"], thin], ["node", "cid", "sketch"])

    level = classes.filter("set_size > 0").select("cid", "sig").mapInArrow(start, "node long, cid long, sketch binary")
    edges = None
    for d in range(depth):
        work = _buckets(small, d == depth - 1, similarity, least)
        done = level.repartition("node").sortWithinPartitions("node").mapInArrow(work, "src long, dst long, node long, cid long, sketch binary").checkpoint()
        found = done.filter("src is not null").select("src", "dst")
        edges = found if edges is None else edges.unionByName(found)
        level = done.filter("node is not null").select("node", "cid", "sketch")
        if level.isEmpty():
            break
    groups = connected_components(edges.distinct())
    links, label = exact_links(docs, groups, classes, width, similarity, block)
    # a row for each class; settled tables, so that each join is of two plain exchanges
    root, n_links = F.coalesce("root", "cid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    of = classes.drop("sig").join(links, "cid", "left").join(label, "cid", "left").select("low", "high", "rep", *["rep_print"] * prints, root, n_links).checkpoint()
    if prints:
        least = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "rep_print")).alias("least")
        names = of.groupBy("root").agg(least).select("root", F.col("least.rep").alias("class_id"), F.col("least.rep_print").alias("class_print")).checkpoint()
    else:
        names = of.groupBy("root").agg(F.min("rep").alias("class_id")).checkpoint()
    of = of.join(names, "root").select("low", "high", "class_id", *["class_print"] * prints, "n_links").checkpoint()
    return seen.join(of, ["low", "high"]).select(F.col("doc_id").alias(key), "class_id", "n_links", "set_size", *["print", "class_print"] * prints)


def exact_links(docs, groups, classes, width, similarity, block, block_tokens=500_000):
    """(cid, links) and (cid, root) from the exact similarities inside each component.

    A component of at most `block` classes and `block_tokens` shingles is one task's matrix.
    In a larger one each class is measured against one of them, the pivot: how many of the
    pivot's shingles it lacks and how many it has.  That alone decides most pairs of a dense
    group, and for all classes of the same measures at once; the others are compared in cells
    of two blocks, and blocks are of neighbouring measures, so cells without an undecided pair
    are left out.  No task holds more than two blocks, whatever the component's size.
    """
    member = groups.join(classes.select("cid", "rep", "rep_print", "copies", "set_size"), F.col("node") == F.col("cid"))
    size = member.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("set_size") / block_tokens)).alias("blocks"))
    member = member.join(size, "component").select("cid", "component", "copies", "rep", "rep_print", "blocks")

    def load(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["cid"], b["component"], b["copies"], b["blocks"], pa.array([s.tobytes() for s in unique_shingles(b["text"], width)], pa.binary())], ["cid", "component", "copies", "blocks", "set"])

    held = docs.join(member, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("print") == F.col("rep_print"))).select("cid", "component", "copies", "blocks", "text")
    held = held.mapInArrow(load, "cid long, component long, copies long, blocks long, set binary").checkpoint()
    none = F.lit(0)
    found = compared(held.filter("blocks = 1").select("component", none.alias("i"), none.alias("j"), none.alias("own"), "cid", "copies", "set", *[none.alias(c) for c in ("pivot", "lacks", "size")]), similarity, block).checkpoint()
    links, label = found.select("cid", "links"), found.select("cid", "root")
    large = held.filter("blocks > 1")
    if not large.isEmpty():
        more, edges = large_links(large.drop("blocks"), similarity, block, block_tokens)
        links = links.unionByName(more)
        label = label.unionByName(connected_components(edges).select(F.col("node").alias("cid"), F.col("component").alias("root")))
    return links.groupBy("cid").agg(F.sum("links").alias("links")), label


def compared(cells, similarity, block):
    """Exact links inside cells (component, i, j): rows cid, links, root, one a class and cell;
    pairs that their measures decide (where there is a pivot) are left out."""

    def compare(batches):
        for (_, i, j), t in K.streamed_groups(batches, "component", "i", "j"):
            cid, first = np.unique(t["cid"].to_numpy(), return_index=True)  # a repeated row's class once
            t = t.take(pa.array(first))
            copies, own, pivot = (t[c].to_numpy() for c in ("copies", "own", "pivot"))
            ok = similar([np.frombuffer(s, "<u8") for s in t["set"].to_pylist()], similarity)
            if i != j:
                ok &= own[:, None] != own[None, :]
            if pivot[0]:
                lacks, size = t["lacks"].to_numpy(), t["size"].to_numpy()
                step = coarse(pivot[0])
                for x in range(len(cid)):
                    yes, no = decided(pivot[0], step, lacks[x] // step, size[x] // step, lacks // step, size // step, similarity)
                    ok[x] &= ~(yes | no)
            root = np.arange(len(cid))
            for a in range(len(cid)):  # breadth first over the links of the cell
                if root[a] == a:
                    todo = [a]
                    while todo:
                        x = todo.pop()
                        new = np.flatnonzero(ok[x] & (root > a))
                        root[new] = a
                        todo.extend(new.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(ok @ copies), pa.array(cid[root])], ["cid", "links", "root"])

    return cells.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(compare, "cid long, links long, root long")


def coarse(pivot):
    """Step of the measures against a pivot of so many shingles, so that few differ."""
    return max(1, int(pivot) // 64)


def decided(pivot, step, lacks, size, lacks2, size2, similarity):
    """(surely similar, surely not) of classes with coarse measures (lacks, size) and others."""
    most = step - 1
    m1, m2, s1, s2 = lacks * step, lacks2 * step, size * step, size2 * step
    low = np.maximum(pivot - (m1 + most) - (m2 + most), 0)  # shingles of the pivot that both have
    yes = (low > 0) & (low >= similarity * (s1 + s2 + 2 * most - low) + 1e-9)
    extra = lambda m, s: np.maximum(s + most - pivot + m + most, 0)
    high = np.minimum(np.maximum(pivot - np.maximum(m1, m2), 0) + np.minimum(extra(m1, s1), extra(m2, s2)), np.minimum(s1, s2) + most)
    no = high < similarity * (s1 + s2 - high) - 1e-6
    return yes, no


def decide(t, similarity, block, tokens):
    """For the measures of one component: what each is surely linked to, and the blocks and
    cells of the rest."""
    order = np.lexsort((t["size"].to_numpy(), t["lacks"].to_numpy()))
    t = t.take(pa.array(order))
    lacks, size, n, copies, rep = (t[c].to_numpy() for c in ("lacks", "size", "n", "copies", "rep"))
    pivot = t["pivot"][0].as_py()
    step, p = coarse(pivot), len(t)
    room = max(1, min(block, int(tokens // max(1, size.max() * step))))
    links, open_, root = np.zeros(p, np.int64), np.zeros(p, bool), np.full(p, -1)
    sure = lambda x: decided(pivot, step, lacks[x], size[x], lacks, size, similarity)
    own = np.zeros(p, bool)
    for x in range(p):
        yes, no = sure(x)
        links[x], own[x] = copies[yes].sum(), yes[x]
        rest = ~(yes | no)
        rest[x] &= n[x] > 1
        open_[x] = rest.any()
    for a in range(p):  # measures that sure links join
        if root[a] < 0:
            root[a], todo = a, [a]
            while todo:
                new = np.flatnonzero(sure(todo.pop())[0] & (root < 0))
                root[new] = a
                todo.extend(new.tolist())
    # blocks of neighbouring measures; one that is alone in its root and not its own links stays apart
    start = np.cumsum(n * open_) - n * open_
    first, last = start // room, (start + np.maximum(n, 1) - 1) // room
    partners = {}
    for x in np.flatnonzero(open_):
        yes, no = sure(x)
        rest = np.flatnonzero(~(yes | no) & open_)
        if n[x] < 2:
            rest = rest[rest != x]
        mine = set(np.concatenate([first[rest], last[rest]]).tolist())
        for y in rest[last[rest] > first[rest] + 1]:
            mine.update(range(int(first[y]), int(last[y])))
        for i in range(first[x], last[x] + 1):
            partners.setdefault(int(i), set()).update(mine)
    joined = np.array([own[x] and n[x] > 1 or (root == root[x]).sum() > 1 for x in range(p)], dtype=bool)
    component = t["component"][0].as_py()
    rows = [(component, int(lacks[x]), int(size[x]), int(links[x]), bool(own[x]), int(rep[root[x]]) if joined[x] else None, int(first[x]) if open_[x] else None, int(last[x]), None, None) for x in range(p)]
    rows += [(component, None, None, None, None, None, None, None, i, sorted(js)) for i, js in partners.items()]
    kinds = [pa.int64()] * 4 + [pa.bool_()] + [pa.int64()] * 4 + [pa.list_(pa.int64())]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split(" ")[0] for c in DECIDED.split(", ")])


DECIDED = "component long, lacks long, size long, sure long, own boolean, label long, first long, last long, block long, partners array<long>"


def large_links(large, similarity, block, tokens):
    """(cid, links) and edges src, dst of components that are more than one block; `large`:
    component, cid, copies, set."""
    pivots = large.filter("cid = component").dropDuplicates(["component"]).select(F.col("component").alias("of"), F.col("set").alias("pivot_set")).checkpoint()

    def measure(batches):
        for b in batches:
            sets, pivots = ([np.frombuffer(s, "<u8") for s in b[c].to_pylist()] for c in ("set", "pivot_set"))
            lacks = [len(p) - len(np.intersect1d(s, p, assume_unique=True)) for s, p in zip(sets, pivots)]
            yield pa.RecordBatch.from_arrays([b["cid"], b["component"], b["copies"], pa.array([len(p) for p in pivots], pa.int64()), pa.array(lacks, pa.int64()), pa.array([len(s) for s in sets], pa.int64())], ["cid", "component", "copies", "pivot", "lacks", "size"])

    measured = large.join(pivots, F.col("component") == F.col("of")).mapInArrow(measure, "cid long, component long, copies long, pivot long, lacks long, size long")
    measured = measured.dropDuplicates(["cid"]).checkpoint()
    step = F.greatest(F.lit(1), F.floor(F.col("pivot") / 64)).cast("long")
    rough = measured.withColumn("l", F.floor(F.col("lacks") / step)).withColumn("s", F.floor(F.col("size") / step))
    profiles = rough.groupBy("component", "pivot", F.col("l").alias("lacks"), F.col("s").alias("size")).agg(F.count("*").alias("n"), F.sum("copies").alias("copies"), F.min("cid").alias("rep"))
    told = profiles.groupBy("component").applyInArrow(lambda t: decide(t, similarity, block, tokens), DECIDED).checkpoint()
    of = told.filter("block is null").select(F.col("component").alias("c"), F.col("lacks").alias("tl"), F.col("size").alias("ts"), "sure", "own", "label", "first", "last")
    known = rough.join(of, (F.col("component") == F.col("c")) & (F.col("l") == F.col("tl")) & (F.col("s") == F.col("ts"))).drop("c", "tl", "ts", "l", "s").checkpoint()
    links = known.select("cid", (F.col("sure") - F.when(F.col("own"), F.col("copies")).otherwise(F.lit(0))).alias("links"))
    edges = known.filter("label is not null").select(F.col("cid").alias("src"), F.col("label").alias("dst"))
    open_ = known.filter("first is not null").withColumn("own", F.col("first") + F.pmod(F.xxhash64("cid"), F.col("last") - F.col("first") + 1)).select("cid", "component", "copies", "pivot", "lacks", "size", "own")
    if not open_.isEmpty():
        cells = told.filter("block is not null").select(F.col("component").alias("c"), F.col("block").alias("b"), F.explode("partners").alias("other"))
        open_ = open_.join(cells, (F.col("component") == F.col("c")) & (F.col("own") == F.col("b"))).drop("c", "b")
        open_ = open_.join(large.select(F.col("cid").alias("id"), "set"), F.col("cid") == F.col("id"))
        cells = open_.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "copies", "set", "pivot", "lacks", "size")
        found = compared(cells, similarity, block).checkpoint()
        links = links.unionByName(found.select("cid", "links"))
        edges = edges.unionByName(found.select(F.col("cid").alias("src"), F.col("root").alias("dst")))
    return links, edges.unionByName(known.select(F.col("cid").alias("src"), F.col("cid").alias("dst")))


def similar(sets, similarity):
    """Boolean matrix of exact Jaccard >= similarity, diagonal false; integers throughout."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    tokens, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True) if n else (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
    row = np.repeat(np.arange(n), size)
    shared = count[inverse] > 1
    new = np.cumsum(count > 1) - 1
    row, col = row[shared], new[inverse[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    inter = np.zeros((n, n), dtype=np.float64)
    step = min(4096, int(col[-1]) + 1) if len(col) else 1
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        lo, hi = np.searchsorted(col, [a, a + step])
        m = np.zeros((n, step), dtype=np.float32)
        m[row[lo:hi], col[lo:hi] - a] = 1
        inter += m @ m.T
    union = size[:, None] + size[None, :] - inter
    ok = inter >= similarity * union - 1e-9
    np.fill_diagonal(ok, False)
    return ok

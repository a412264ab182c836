"""Names that tell: data structures, design patterns, algorithms, language richness, magic constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import name_parts

# Suffixes of type names. The structure's name is the suffix split
# at its capitals, unless RENAMED says otherwise.
STRUCTURES = {
    "linear": "SinglyLinkedList DoublyLinkedList CircularLinkedList LinkedList SkipList SelfOrganizingList AssociationList DifferenceList SortedList FreeList DynamicArray GrowableArray ArrayList SortedArray ParallelArray HashedArrayTree SuffixArray DopeVector PriorityQueue DoubleEndedQueue BlockingQueue ConcurrentQueue WorkQueue MessageQueue EventQueue TaskQueue CircularQueue CircularBuffer RingBuffer DoubleBuffer TripleBuffer Zipper Deque Stack Queue",
    "tree": "BinarySearchTree BinaryTree CartesianTree OrderStatisticTree RedBlackTree SplayTree ScapegoatTree Treap SegmentTree FenwickTree IntervalTree RangeTree FingerTree SuffixTree RadixTree CompressedTrie TernarySearchTrie PatriciaTrie PrefixTree Trie LinkCutTree EulerTourTree TernaryTree QuadTree Octree CoverTree MetricTree TangoTree TopTree ZipTree MerkleTree AbstractSyntaxTree SyntaxTree ParseTree DecisionTree ExpressionTree FibonacciHeap BinomialHeap PairingHeap LeftistHeap SkewHeap SoftHeap BinaryHeap IndexedHeap MinHeap MaxHeap Heap Tree",
    "hashed": "HashTable LinkedHashMap HashMap HashSet HashList BloomFilter CountingBloomFilter CuckooFilter QuotientFilter XorFilter CuckooHash RobinHoodHash HopscotchHash CountMinSketch ConsistentHashRing ConsistentHash RollingHash MinHash SimHash",
    "graph": "DirectedAcyclicGraph DirectedGraph UndirectedGraph SceneGraph DisjointSet UnionFind AdjacencyList AdjacencyMatrix IncidenceMatrix EdgeList ControlFlowGraph DependencyGraph CallGraph FlowNetwork Multigraph Hypergraph Graph",
    "other": "SparseMatrix RoutingTable SymbolTable LookupTable JumpTable TranspositionTable PieceTable BitArray BitVector BitSet BitField WaveletTree GapBuffer OrderedSet OrderedMap SortedSet SortedMap PersistentVector ImmutableArray Multiset Rope Blockchain",
}
RENAMED = {"SinglyLinkedList": "Linked List", "DoublyLinkedList": "Linked List", "CircularLinkedList": "Linked List", "GrowableArray": "Dynamic Array", "ArrayList": "Dynamic Array", "DoubleEndedQueue": "Deque", "CircularQueue": "Circular Buffer", "RingBuffer": "Circular Buffer", "PrefixTree": "Trie", "LinkedHashMap": "Hash Map", "UnionFind": "Disjoint Set", "ConsistentHashRing": "Consistent Hash"}
# Suffixes of type names and the design pattern they name.
PATTERNS = {
    "Builder": "Builder", "Adapter": "Adapter", "Bridge": "Bridge", "Composite": "Composite", "Decorator": "Decorator", "Facade": "Facade", "Flyweight": "Flyweight", "Proxy": "Proxy", "Cache": "Caching",
    "Strategy": "Strategy", "Observer": "Observer", "Listener": "Observer", "Subscriber": "Observer", "Publisher": "Observer", "Delegate": "Delegation", "Command": "Command", "Visitor": "Visitor", "Mediator": "Mediator",
    "Memento": "Memento", "Snapshot": "Memento", "Iterator": "Iterator", "Interpreter": "Interpreter", "FeatureFlag": "Feature Flag", "FeatureToggle": "Feature Flag", "FeatureGate": "Feature Flag",
    "ServiceLocator": "Dependency Injection", "DIContainer": "Dependency Injection", "Injector": "Dependency Injection",
}
# Words of function names, all of which must occur, and the algorithm they name.
ALGORITHMS = {
    "bubble sort": "Bubble Sort", "insertion sort": "Insertion Sort", "selection sort": "Selection Sort", "merge sort": "Merge Sort", "quick sort": "Quicksort", "heap sort": "Heapsort", "counting sort": "Counting Sort", "radix sort": "Radix Sort", "shell sort": "Shellsort", "bucket sort": "Bucket Sort", "tim sort": "Timsort",
    "binary search": "Binary Search", "linear search": "Linear Search", "interpolation search": "Interpolation Search", "ternary search": "Ternary Search", "fibonacci search": "Fibonacci Search", "quick select": "Quickselect", "quickselect": "Quickselect",
    "dijkstra": "Dijkstra", "bellman ford": "Bellman-Ford", "floyd warshall": "Floyd-Warshall", "breadth first": "Breadth-First Search", "bfs": "Breadth-First Search", "depth first": "Depth-First Search", "dfs": "Depth-First Search", "kruskal": "Kruskal (MST)", "topological sort": "Topological Sort", "toposort": "Topological Sort", "tarjan": "Tarjan (SCC)", "kosaraju": "Kosaraju (SCC)", "ford fulkerson": "Ford-Fulkerson (Max Flow)", "edmonds karp": "Edmonds-Karp (Max Flow)",
    "knuth morris pratt": "Knuth-Morris-Pratt", "kmp": "Knuth-Morris-Pratt", "rabin karp": "Rabin-Karp", "boyer moore": "Boyer-Moore", "aho corasick": "Aho-Corasick", "manacher": "Manacher", "levenshtein": "Levenshtein (Edit Distance)", "edit distance": "Levenshtein (Edit Distance)", "longest common subsequence": "Longest Common Subsequence",
    "gcd": "Euclidean GCD", "eratosthenes": "Sieve of Eratosthenes", "miller rabin": "Miller-Rabin Primality", "newton raphson": "Newton-Raphson", "fast fourier": "Fast Fourier Transform", "karatsuba": "Karatsuba Multiplication", "knapsack": "Knapsack (DP)", "kadane": "Kadane (Max Subarray)", "huffman": "Huffman Coding", "fibonacci": "Fibonacci",
}
# The reserved words whose use is counted.
KEYWORDS = {
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda match case nonlocal not or pass raise return try while with yield",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends false final finally float for goto if implements import instanceof int interface long native new null package private protected public return short static strictfp super switch synchronized this throw throws transient true try void volatile while var yield record sealed permits",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union unsafe use where while",
    "ts": "any as asserts await bigint boolean break case catch class const constructor continue debugger declare default delete do else enum export extends false finally for from function if implements import in infer instanceof interface is keyof let module namespace never new null object of package private protected public readonly return static super switch symbol this throw true try type typeof undefined unknown var void while with yield",
}
# Numbers that belong to known algorithms.
CONSTANTS = {
    "01000193": "FNV-1/1a (32-bit prime)", "811c9dc5": "FNV-1/1a (32-bit offset basis)", "00000100000001b3": "FNV-1/1a (64-bit prime)", "cbf29ce484222325": "FNV-1/1a (64-bit offset basis)",
    "edb88320": "CRC-32 (reflected polynomial)", "04c11db7": "CRC-32 (polynomial)", "1edc6f41": "CRC-32C / Castagnoli (polynomial)", "8005": "CRC-16/IBM (polynomial)", "1021": "CRC-16/CCITT (polynomial)", "42f0e1eba9ea3693": "CRC-64/XZ (polynomial)",
    "67452301": "MD5 / SHA-1 (initialization vector)", "efcdab89": "MD5 / SHA-1 (initialization vector)", "98badcfe": "MD5 / SHA-1 (initialization vector)", "10325476": "MD5 / SHA-1 (initialization vector)", "c3d2e1f0": "SHA-1 (initialization vector)",
    "6a09e667": "SHA-256 (initialization vector)", "bb67ae85": "SHA-256 (initialization vector)", "3c6ef372": "SHA-256 (initialization vector)", "a54ff53a": "SHA-256 (initialization vector)", "510e527f": "SHA-256 (initialization vector)", "9b05688c": "SHA-256 (initialization vector)", "1f83d9ab": "SHA-256 (initialization vector)", "5be0cd19": "SHA-256 (initialization vector)",
    "9908b0df": "Mersenne Twister (MT19937 matrix A)", "6c078965": "Mersenne Twister (MT19937 seed step)", "2545f4914f6cdd1d": "xorshift64star", "9e3779b9": "Fibonacci hashing (32-bit golden ratio)", "9e3779b97f4a7c15": "Fibonacci hashing / SplitMix64 (64-bit golden ratio)", "bf58476d1ce4e5b9": "SplitMix64 (mix constant)", "94d049bb133111eb": "SplitMix64 (mix constant)", "5851f42d4c957f2d": "PCG32 (default multiplier)", "14057b7ef767814f": "PCG32 (default increment)",
    "5bd1e995": "MurmurHash2", "cc9e2d51": "MurmurHash3", "1b873593": "MurmurHash3", "85ebca6b": "MurmurHash3 (finalizer)", "c2b2ae35": "MurmurHash3 (finalizer)", "ff51afd7ed558ccd": "MurmurHash3 (64-bit finalizer)", "c4ceb9fe1a85ec53": "MurmurHash3 (64-bit finalizer)", "9e3779b185ebca87": "xxHash64 (prime 1)", "c2b2ae3d27d4eb4f": "xxHash64 (prime 2)", "165667b19e3779f9": "xxHash64 (prime 3)",
}


def structure_name(suffix: str) -> str:
    import re

    return RENAMED.get(suffix) or re.sub(r"(?<=[a-z])(?=[A-Z])", " ", suffix)


def suffixes(spark: SparkSession) -> DataFrame:
    """The catalogue of suffixes: (suffix, kind, name)."""
    rows = [(s, "structure", structure_name(s)) for group in STRUCTURES.values() for s in group.split()] + [(s, "pattern", n) for s, n in PATTERNS.items()]
    return spark.createDataFrame(rows, "suffix string, kind string, name string")


def _longest(text, names: dict[str, str]):
    """The longest suffix of the catalogue that a column's text ends with, as one expression: longer ones are asked first."""
    cases = " ".join(f"WHEN endswith({text}, '{s}') THEN '{names[s]}'" for s in sorted(names, key=lambda s: (-len(s), s)))
    return F.expr(f"CASE {cases} END")


def named_types(decls: DataFrame) -> DataFrame:
    """Declared types whose names tell a structure or a pattern: (name, structure, pattern). No join: the catalogue is the expression."""
    structures = {s: structure_name(s) for group in STRUCTURES.values() for s in group.split()}
    return decls.withColumn("structure", _longest("name", structures)).withColumn("pattern", _longest("name", PATTERNS)).filter("structure IS NOT NULL OR pattern IS NOT NULL")


def named_algorithms(functions: DataFrame, name: str = "symbol") -> DataFrame:
    """Functions whose names tell an algorithm: all its words occur; more words win, then the longer signature."""
    words = name_parts(name)
    out = F.lit(None).cast("string")
    for key in sorted(ALGORITHMS, key=lambda k: (len(k.split()), len(k), k)):
        need = F.array(*map(F.lit, key.split()))
        out = F.when(F.size(F.array_except(need, F.col("words"))) == 0, F.lit(ALGORITHMS[key])).otherwise(out)
    return functions.withColumn("words", words).withColumn("algorithm", out).drop("words").filter("algorithm IS NOT NULL")


def richness(lines: DataFrame) -> DataFrame:
    """Reserved words used, of each language: (language_id, used, total, share).

    Words are distinct per file before they are shuffled; the answer has a row a language.
    """
    known = F.create_map(*(x for k, v in KEYWORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v.split())))))
    words = F.array_intersect(F.array_distinct(F.regexp_extract_all("stripped", F.lit(r"[A-Za-z_]\w*"), F.lit(0))), F.try_element_at(known, F.col("language_id")))
    used = lines.filter(~F.col("comment") & F.col("language_id").isin(*KEYWORDS)).select("language_id", F.explode(words).alias("word")).distinct()
    total = F.coalesce(*(F.when(F.col("language_id") == k, F.lit(len(v.split()))) for k, v in KEYWORDS.items()))
    return used.groupBy("language_id").agg(F.count("*").alias("used")).withColumn("total", total).withColumn("share", F.round(F.col("used") / F.col("total"), 4))


def magic_constants(lines: DataFrame) -> DataFrame:
    """Numbers of known algorithms in code: (file_id, line_no, literal, constant). Values below 65536 count in hex only."""
    hexes = F.transform(F.regexp_extract_all("stripped", F.lit(r"\b0[xX]([0-9a-fA-F_]+)"), F.lit(1)), lambda x: F.lower(F.regexp_replace(x, "_", "")))
    longs = F.transform(F.regexp_extract_all("stripped", F.lit(r"(?<![\w.])(\d{6,20})(?![\w.])"), F.lit(1)), lambda x: F.lower(F.conv(x, 10, 16)))
    strip0 = lambda x: F.regexp_replace(x, "^0+", "")
    known = F.create_map(*(x for k, v in CONSTANTS.items() for x in (F.lit(k.lstrip("0")), F.lit(v))))
    found = lines.filter(~F.col("comment") & F.col("stripped").rlike(r"0[xX]|\d{6}")).select("file_id", "line_no", F.explode(F.array_distinct(F.transform(F.concat(hexes, longs), strip0))).alias("literal"))
    return found.withColumn("constant", F.try_element_at(known, F.col("literal"))).filter("constant IS NOT NULL")

"""The inner loop of skip-gram with hierarchical softmax, in the JVM: Java that Spark's own compiler translates once per context."""

from __future__ import annotations

import zipfile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..plans.ship import shared_folder

NAME = "wordtide_skip_gram"
#: Numbers of one model, as int32 little-endian: words, terms, path entries, dimensions, epochs, window, and the seed as two;
#: then as float32 the rates (first, least) and each term's chance to be kept; as int32 sentence lengths' number, these
#: lengths, words, ends of the paths, path nodes, and codes of the paths.
SOURCE = r"""
package wordtide;

public class SkipGram implements org.apache.spark.sql.api.java.UDF1 {
    static final dev.ludovic.netlib.blas.BLAS B = dev.ludovic.netlib.blas.JavaBLAS.getInstance();

    public Object call(Object packed) throws Exception {
        java.nio.ByteBuffer in = java.nio.ByteBuffer.wrap((byte[]) packed).order(java.nio.ByteOrder.LITTLE_ENDIAN);
        int n = in.getInt(), terms = in.getInt(), entries = in.getInt(), d = in.getInt(), epochs = in.getInt(), window = in.getInt();
        long low = in.getInt() & 0xffffffffL;
        long key = low | (((long) in.getInt()) << 32);
        float rate = in.getFloat(), least = in.getFloat();
        float[] keep = new float[terms];
        for (int i = 0; i < terms; i++) keep[i] = in.getFloat();
        int sentences = in.getInt();
        int[] lengths = ints(in, sentences), words = ints(in, n), ends = ints(in, terms), path = ints(in, entries), code = ints(in, entries);
        float[] vectors = new float[terms * d], inner = new float[Math.max(1, terms - 1) * d];
        for (int i = 0; i < terms * d; i++) vectors[i] = (float) ((unit(key, -1L - i) - 0.5) / d);
        int longest = 0, most = 0;
        for (int i = 0; i < terms; i++) longest = Math.max(longest, ends[i] - (i == 0 ? 0 : ends[i - 1]));
        for (int s = 0; s < sentences; s++) most = Math.max(most, lengths[s]);
        float[] old = new float[longest * d], g = new float[2 * window * longest];
        int[] near = new int[2 * window], own = new int[most], reach = new int[most];
        double total = (double) epochs * Math.max(1, n);
        for (int e = 0; e < epochs; e++) {
            int at = 0;
            for (int s = 0; s < sentences; s++) {
                long done = (long) e * n + at;
                float alpha = (float) Math.max(least, rate * (1 - done / total));
                int kept = 0;
                for (int i = 0; i < lengths[s]; i++) {
                    double x = unit(key, 2 * (done + i));
                    if (x < keep[words[at + i]]) {
                        own[kept] = words[at + i];
                        reach[kept++] = 1 + (int) (unit(key, 2 * (done + i) + 1) * window);
                    }
                }
                at += lengths[s];
                sentence(vectors, inner, d, own, reach, kept, alpha, ends, path, code, longest, old, g, near);
            }
        }
        double[][] out = new double[terms][];
        for (int i = 0; i < terms; i++) {
            out[i] = new double[d];
            for (int x = 0; x < d; x++) out[i][x] = vectors[i * d + x];
        }
        return out;
    }

    static int[] ints(java.nio.ByteBuffer in, int n) {
        int[] out = new int[n];
        in.asIntBuffer().get(out);
        in.position(in.position() + 4 * n);
        return out;
    }

    static double unit(long key, long i) {
        long z = key + i * 0x9E3779B97F4A7C15L;
        z = (z ^ (z >>> 30)) * 0xBF58476D1CE4E5B9L;
        z = (z ^ (z >>> 27)) * 0x94D049BB133111EBL;
        return ((z ^ (z >>> 31)) >>> 11) * (1.0 / (1L << 53));
    }

    static void sentence(float[] v, float[] inner, int d, int[] own, int[] reach, int kept, float alpha, int[] ends, int[] path, int[] code, int longest, float[] old, float[] g, int[] near) {
        for (int i = 0; i < kept; i++) {
            int from = Math.max(0, i - reach[i]), to = Math.min(kept, i + reach[i] + 1), n = 0;
            for (int j = from; j < to; j++) if (j != i) near[n++] = own[j] * d;
            int first = own[i] == 0 ? 0 : ends[own[i] - 1], p = ends[own[i]] - first;
            if (n == 0 || p == 0) continue;
            for (int k = 0; k < p; k++) {
                int node = path[first + k] * d, was = k * d, j = 0;
                System.arraycopy(inner, node, old, was, d);
                for (; j < n; j++) {
                    float z = Math.min(30f, Math.max(-30f, dot(old, was, v, near[j], d)));
                    g[j * longest + k] = alpha * (1f - code[first + k] - (float) (1.0 / (1.0 + Math.exp(-z))));
                }
                for (j = 0; j + 2 <= n; j += 2) add2(inner, node, v, near[j], near[j + 1], g[j * longest + k], g[(j + 1) * longest + k], d);
                if (j < n) add(inner, node, v, near[j], g[j * longest + k], d);
            }
            for (int j = 0; j < n; j++) {
                int k = 0;
                for (; k + 2 <= p; k += 2) add2(v, near[j], old, k * d, (k + 1) * d, g[j * longest + k], g[j * longest + k + 1], d);
                if (k < p) add(v, near[j], old, k * d, g[j * longest + k], d);
            }
        }
    }

    static float dot(float[] a, int i, float[] b, int j, int d) {
        return B.sdot(d, a, i, 1, b, j, 1);
    }

    static void add(float[] y, int i, float[] a, int j, float g, int d) {
        for (int x = 0; x < d; x++) y[i + x] += g * a[j + x];
    }

    static void add2(float[] y, int i, float[] a, int j, int k, float g, float h, int d) {
        for (int x = 0; x < d; x++) y[i + x] += g * a[j + x] + h * a[k + x];
    }
}
"""


def ready(spark: SparkSession) -> None:
    """The loop as a function of this session; its class goes to the executors as a jar, once per context."""
    sc = spark.sparkContext
    if not getattr(sc, "_wordtide_loop", None):
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(spark._jsparkSession.getClass().getClassLoader())
        compiler.setTargetVersion(8)
        compiler.cook(SOURCE)
        path = shared_folder(spark) / "wordtide-loop.jar"
        with zipfile.ZipFile(path, "w") as z:
            for name, code in compiler.getBytecodes().items():
                z.writestr(name.replace(".", "/") + ".class", bytes(code))
        sc._jsc.addJar(str(path))
        sc._wordtide_loop = compiler.getClassLoader().loadClass("wordtide.SkipGram").getDeclaredConstructor(sc._gateway.new_array(spark._jvm.java.lang.Class, 0)).newInstance(sc._gateway.new_array(spark._jvm.java.lang.Object, 0))
    kind = spark._jsparkSession.parseDataType('{"type":"array","elementType":{"type":"array","elementType":"double","containsNull":false},"containsNull":false}')
    spark._jsparkSession.udf().register(NAME, sc._wordtide_loop, kind)


def trained(packed: Column) -> Column:
    return F.call_udf(NAME, packed)

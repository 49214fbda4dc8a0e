"""Operators of a training-data pipeline, each a function from DataFrames to a DataFrame.

``quality``   byte-level convolutional quality classifier
``pii``       personal data by a semi-Markov conditional random field
``lm``        language-model scores by deleted interpolation
``lines``     fuzzy line deduplication
``near``      near duplicates by DartMinHash
``language``  language by known words, then character n-grams
``exact``     exact duplicates through an extendible-hash index
``repeats``   repeated passages by blockwise suffix classes with a difference cover
``decontam``  benchmark windows found in documents
``mixing``    Pfair interleaving of sources
``whitening`` embeddings on the components of their covariance
``negatives`` hard negatives by a vertical scan with bounds
``spectral``  eigenvectors of one matrix by QDWH divide and conquer
``warc``      WARC archives, read in splits by boundary chains
``queries``   the registered queries and their SQL

Nothing else in the library imports this subpackage.
"""

"""Reading and writing: text codecs, stream readers, the versioned model store."""

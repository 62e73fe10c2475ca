"""edgeloom.sources"""

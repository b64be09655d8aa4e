"""obslytics.sources"""
